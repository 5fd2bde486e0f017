"""Curated terms of the subjects, in English, German, French and Spanish: their vocabulary, not pieces of sentences.

A term that belongs to one subject alone is strong. One after ``~`` is also at home elsewhere; it supports a subject that strong
terms have already shown and never shows one by itself. English and Romance terms also match with a plural ending.
"""

TERMS = {
    "software": """
        hash table, refactoring, query planner, call graph, null pointer, compiler, merge request, pull request, memory leak, unit test, race condition,
        linter, type checker, stack trace, circular import, null check, hotfix, build server, deprecated, async, regex, source code, debugger,
        garbage collector, api, back end, front end, database schema, data type, command line, deadlock, exception handler, open source, bug, commit, await,
        code review, software, programmer, javascript, typescript, runtime, segfault, repository, middleware, endpoint, stack overflow, parser, dependency,
        speicherleck, speicherlecks, testlauf, testläufe, datentyp, datentypen, fehlermeldung, fehlermeldungen, zwischenspeicher, übersetzer, schnittstelle,
        schnittstellen, abhängigkeit, abhängigkeiten, quelltext, laufzeit, nullzeiger, datenbank, compilerfehler, programmierer, entwickler, softwarefehler,
        pile d'appels, piles d'appels, fuite de mémoire, fuites de mémoire, test unitaire, tests unitaires, dépendance, compilateur, valeur nulle, mise à jour,
        logiciel, base de données, code source, développeur, interface de programmation, débogueur, fuga de memoria, fugas de memoria, prueba unitaria,
        pruebas unitarias, hilo de ejecución, hilos de ejecución, dependencia, compilador, compiladores, valor nulo, código fuente, base de datos,
        desarrollador, depurador, pila de llamadas, caché, compile, codebase, refactor, debugging, programming language, operating system, web server,
        web browser, source file, syntax error, segmentation fault, buffer overflow, heap allocation, mutex, semaphore, multithreading, concurrency,
        pointer arithmetic, recursion, binary search, linked list, boolean, string literal, type inference, static analysis, test suite, test coverage,
        continuous integration, deployment pipeline, feature flag, microservice, kubernetes, docker, git, changelog, backport, regression test,
        integration test, mocking framework, sql query, foreign key, orm, http request, json payload, rest api, graphql, webhook, serialization,
        deserialization, caching layer, load balancer, message queue, callback, subclass, stdout, stderr, kernel module, device driver, firmware, bytecode,
        virtual machine, package manager, lockfile, typescript compiler, user interface, software engineer, crash report, off-by-one, infinite loop,
        thread pool, event loop, connection pool, stack frame, config file, environment variable, log file, release candidate, semantic versioning,
        encryption library, backend, frontend, quellcode, softwareentwicklung, programmierung, programmiersprache, betriebssystem, kompilieren, endlosschleife,
        ausnahmebehandlung, speicherverwaltung, testabdeckung, komponententest, komponententests, versionsverwaltung, benutzeroberfläche, schleife, variablen,
        browser, absturz, entwicklerin, bibliotheksfunktion, refaktorierung, programmation, langage de programmation, système d'exploitation, compilation,
        boucle infinie, bogue, bogues, développeuse, serveur, navigateur, gestionnaire de versions, bibliothèque logicielle, requête sql,
        interface utilisateur, ramasse-miettes, programación, lenguaje de programación, sistema operativo, compilar, bucle infinito, programador, programadora,
        servidor, navegador, control de versiones, biblioteca de software, consulta sql, interfaz de usuario, recolector de basura, excepción, depuración,
        refactorización, desarrolladora
        ~ container, platform, key, release, thread, index, session, branch, cache, build, version, import, module, function, call, test, type, zweig, zweige,
        branche, interface, programm, fehler, update, tipo, tipos, rama, ramas, interfaces, log, model, sprint, record, table, field, promise, library, crash,
        warning, laptop, caller, partition, clause, server, pointer, array, string, loop, script, process, port, memory, program, variable, exception, python,
        closure, iterator, java, rust, interpreter
        """,
    "science": """
        peer review, control group, error bar, sediment, hypothesis, genome, telescope, isotope, microscope, enzyme, galaxy, fossil, catalyst, laboratory,
        kelvin, mutation rate, ultraviolet, algae, gravity, physicist, chemist, biologist, geologist, astronomer, molecule, photosynthesis, electron, proton,
        neutron, quantum, experiment, mice, species, chemistry, physics, biology, spectrometer, dna, protein, particle, orbit, spectrum, gesteinsschicht,
        gesteinsschichten, messreihe, messreihen, teleskop, teleskope, fossilien, galaxie, galaxien, hypothese, hypothesen, enzym, kristall, labor, forscher,
        wissenschaftler, molekül, schwerkraft, mutation, sédiment, série de mesures, séries de mesures, hypothèse, télescope, fossile, cristal, expérience,
        laboratoire, kelvins, chercheur, molécule, échantillon, sedimento, hipótesis, telescopio, isótopo, fósil, fósiles, galaxia, enzima, experimento,
        laboratorio, medición, mediciones, investigador, molécula, scientist, researcher, scientific, astronomy, astrophysics, geology, genetics, bacterium,
        bacteria, microbe, atom, photon, neutrino, radioactive, radioactivity, half-life, supernova, black hole, dark matter, starlight, exoplanet, asteroid,
        comet, planetary, light-year, redshift, cosmology, thermodynamics, entropy, relativity, wavelength, infrared, x-ray diffraction, spectroscopy,
        mass spectrometry, chromatography, titration, reagent, polymer, crystallography, crystallisation, crystallization, crystal lattice, semiconductor,
        superconductor, magnetic field, tectonic, earthquake, magma, volcanic eruption, seismic, glacier, paleontologist, palaeontologist, archaeologist,
        climate model, greenhouse gas, carbon dioxide, ecosystem, biodiversity, natural selection, chromosome, mitochondria, rna, amino acid, gene expression,
        fruit fly, petri dish, pipette, centrifuge, standard deviation, statistically significant, double-blind, replication study, empirical, observatory,
        particle accelerator, collider, radiocarbon, stratum, plankton, organism, pollen, absolute zero, viscosity, measurement uncertainty, wavelengths,
        wissenschaft, forschung, forscherin, physik, physiker, physikerin, chemie, chemiker, chemikerin, biologie, biologin, biologe, astronom, astronomin,
        atome, elektron, elektronen, teilchen, teilchenbeschleuniger, schwarzes loch, gletscher, vulkan, erdbeben, mikroskop, mikroskope, genom, bakterien,
        moleküle, experimente, versuchsreihe, versuchsaufbau, messung, messungen, messwerte, spektrum, wellenlänge, sternwarte, kontrollgruppe, messfehler,
        kristalle, sedimente, scientifique, chercheuse, physicien, physicienne, chimie, chimiste, biologiste, astronome, électron, particule, trou noir,
        planète, volcan, séisme, génome, bactérie, évolution, longueur d'onde, groupe témoin, observatoire, gravité, cristaux, barre d'erreur, científico,
        científica, investigadora, físico, química, biología, biólogo, astrónomo, átomo, electrón, partícula, agujero negro, glaciar, volcán, terremoto,
        microscopio, genoma, evolución, longitud de onda, grupo de control, observatorio, gravedad, cristales, muestra de laboratorio, experimentos
        ~ cell, solution, reaction, sample, model, culture, scale, field, theory, paper, curve, proben, probe, muestra, muestras, échantillons, mass, light,
        star, layer, operation, scan, record, track, key, lab, evolution, nucleus, ion, planet, planeten, planeta, physique, física, star light, crystal,
        observation, observatory time, measurement, temperature, volcano
        """,
    "law": """
        statute, precedent, witness, plaintiff, deed, judge, notary, injunction, lawyer, acquitted, ruling, tenant, heirs, unlawfully, defendant, prosecutor,
        verdict, attorney, legislation, jurisdiction, lawsuit, litigation, estate, courtroom, bailiff, affidavit, tort, clause, kläger, vollmacht, vollmachten,
        berufung, berufungen, urteil, urteile, klausel, klauseln, paragraf, paragrafen, zeuge, zeugen, angeklagter, angeklagte, freigesprochen,
        mangels beweisen, einspruch, gericht, gerichtshof, richter, richterin, anwalt, anwältin, gesetz, vertrag, verträge, notar, klage, plaignant,
        procuration, témoin, jugement, accusé, l'accusé, relaxé, faute de preuves, faire opposition, tribunal, juge, avocat, notaire, loi, contrat, demandante,
        poder notarial, poderes notariales, audiencia, sentencia, apelación, apelaciones, cláusula, testigo, acusado, absuelto, falta de pruebas, recurrir,
        juez, abogado, abogada, notario, ley, contrato, legal, court order, supreme court, appeals court, appellate, high court, court ruling,
        legal proceedings, jury, juror, testimony, testify, testified, testifies, cross-examination, indictment, indicted, felony, misdemeanor, misdemeanour,
        perjury, custody hearing, restraining order, subpoena, search warrant, arrest warrant, plea bargain, pleaded guilty, conviction, sentenced, parole,
        probation, acquittal, barrister, solicitor, paralegal, magistrate, arbitration, arbitrator, mediation, negligence, breach of contract, contractual,
        lease agreement, landlord, eviction, inheritance, probate, testator, executor, last will, power of attorney, trademark, copyright infringement,
        patent claim, unconstitutional, constitutional, criminal code, civil code, case law, burden of proof, inadmissible, admissible, hearsay, prosecution,
        prosecute, plaintiffs, respondent, appellant, amicus, class action, void contract, null and void, easement, warranty claim, statute of limitations,
        statutory, legislature, bylaw, ordinance, duress, coercion, defamation, libel, sued, unlawful, rechtlich, rechtskräftig, rechtsanwalt, rechtsanwältin,
        staatsanwalt, staatsanwältin, staatsanwaltschaft, verteidiger, klägerin, beklagte, beklagter, gerichtsverfahren, landgericht, amtsgericht,
        oberlandesgericht, bundesgerichtshof, verfassungsgericht, gesetze, gesetzbuch, strafrecht, schadensersatz, schadenersatz, mietvertrag, mieter,
        vermieter, kündigung, erbe, erben, testament, zeugin, zeugenaussage, eid, revision, vergleich vor gericht, verurteilt, haftstrafe, bewährung,
        beweislast, beweismittel, einstweilige verfügung, verjährung, paragraphen, notarin, urkunde, vertragsstrafe, juridique, cour d'appel,
        cour de cassation, procureur, avocate, défendeur, défenderesse, prévenu, juré, témoignage, sous serment, condamné, acquitté, acquittement,
        dommages et intérêts, dommages-intérêts, bail commercial, locataire, propriétaire bailleur, héritier, code civil, code pénal, prescription acquisitive,
        jurisprudence, plainte, procès, huissier, preuve irrecevable, assignation, référé, magistrat, législation, tribunaux, jurídico, jurídica,
        tribunal supremo, fiscal del estado, demandado, demandada, jurado, testimonio, testificar, bajo juramento, condenado, condenada, absolución,
        daños y perjuicios, arrendamiento, arrendatario, inquilino, heredero, testamento, código civil, código penal, jurisprudencia, pleito, querella,
        magistrado, legislación, testigos, cláusulas, jueza, recurso de apelación, juzgado, incumplimiento de contrato
        ~ court, settlement, case, trial, bench, hearing, brief, contract, appeal, motion, liability, party, filing, custody, frist, fristen, délai, délais,
        appel, appels, plazo, plazos, agreement, bar, discharge, suite, suit, sentence, authority, documents, bail, bond, transfer, title, code, record, term,
        audience, permit, sue, counsel, object, claim, paragraph, law, droit, recht, derecho, damages, oath, will, seal, defence, sworn, convicted, juicio
        """,
    "sport": """
        striker, league table, injury time, training camp, referee, medal, goalkeeper, tournament, stadium, counter-attack, baton, podium, qualifying,
        relegated, winger, hamstring, athlete, championship, football, hockey, basketball, tennis, marathon, cyclist, offside, playoffs, midfielder, defender,
        gymnast, olympic, world cup, sprint, penalty, stürmer, staffel, staffeln, turnier, turniere, medaille, medaillen, torhüter, torwart, spieltag,
        spieltage, schiedsrichter, stadion, stadien, mannschaft, meisterschaft, fußball, stade, entraîneur, gardien de but, gardiens de but,
        journée de championnat, journées de championnat, attaquant, arbitre, médaille, tournoi, coureur, joueur, jornada de liga, jornadas de liga, árbitro,
        medalla, relevo, portero, delantero, torneo, estadio, entrenador, entrenadores, partido, jugador, campeonato, sport, sports, athletic, athletics,
        soccer, rugby, baseball, volleyball, handball, badminton, golfer, boxer, wrestling, wrestler, swimmer, swimming, backstroke, freestyle, sprinter,
        hurdler, hurdles, decathlon, triathlon, relay race, long jump, high jump, pole vault, javelin, rowing, rower, regatta, skiing, skier, slalom, biathlon,
        skating, peloton, cycling, time trial, tour de france, goalless, goalscorer, equaliser, equalizer, hat-trick, hat trick, own goal, free kick,
        corner kick, penalty shootout, penalty kick, red card, yellow card, extra time, half-time, kick-off, kickoff, full-back, centre-back, centre-forward,
        substitute bench, dugout, linesman, umpire, touchline, touchdown, quarterback, home run, wicket, batsman, innings, free throw, three-pointer, dunk,
        puck, power play, tie-break, match point, grand slam, serve and volley, semifinal, semi-final, quarter-final, quarterfinal, runner-up, gold medal,
        silver medal, bronze medal, world record, personal best, world champion, champion, promotion playoff, relegation, knockout stage, group stage,
        season opener, teammate, head coach, clean sheet, doping, scoreboard, scoreline, grandstand, finish line, photo finish, winning streak, weightlifting,
        gymnastics, judo, olympics, fußballspiel, fußballer, schwimmer, schwimmerin, läufer, läuferin, radrennen, radfahrer, leichtathletik, skirennen,
        abseits, elfmeter, freistoß, eckball, rote karte, gelbe karte, halbzeit, nachspielzeit, verlängerung, anpfiff, abpfiff, ausgleichstreffer, torschütze,
        mittelfeld, verteidigerin, tabellenführer, aufstieg, abstieg, weltmeister, weltmeisterin, weltmeisterschaft, europameisterschaft, olympische spiele,
        halbfinale, viertelfinale, goldmedaille, unentschieden, bundesliga, tabelle der liga, stürmerin, torhüterin, schiedsrichterin, zuschauertribüne,
        staffellauf, tor des spiels, cyclisme, cycliste, nageur, nageuse, natation, athlétisme, sprinteur, hors-jeu, pénalty, coup franc, carton rouge,
        carton jaune, mi-temps, prolongation, coup d'envoi, égalisation, buteur, milieu de terrain, défenseur, relégation, promotion en ligue,
        champion du monde, championne, coupe du monde, jeux olympiques, demi-finale, quart de finale, médaille d'or, match nul, vestiaire, entraîneuse,
        équipe adverse, joueuse, championnat, fútbol, futbolista, baloncesto, ciclismo, ciclista, nadador, nadadora, natación, atletismo, velocista, maratón,
        fuera de juego, penalti, tiro libre, tarjeta roja, tarjeta amarilla, descanso del partido, prórroga, saque inicial, empate, goleador, centrocampista,
        defensa central, campeón, campeona, campeón del mundo, mundial, juegos olímpicos, cuartos de final, medalla de oro, vestuario, entrenadora,
        aficionados, jugadora, delantera, arquero, goles
        ~ coach, score, pitch, relay, season, match, fixture, track, transfer, draft, court, bench, run, goal, team, relais, field, record, default, motion,
        discharge, stock, bar, key, lap, form, pool, final, swim, sieg, niederlage, victoire, défaite, victoria, derrota, verein, finale, gol, ascenso,
        descenso, rebound, derby, golf, boxing, cricket, fencing, champions, fans, supporter, supporters, gardien, promotion, trainer, rencontre, partie,
        lap time
        """,
    "medicine": """
        nurse, triage, patient, dosage, anaesthetic, symptom, relapse, biopsy, blood pressure, prescription, allergy, vaccine, infusion, diagnosis, surgeon,
        fever, cough, injections, nausea, infection, stitches, heart rhythm, pills, ultrasound, kidney, tablets, follow-up visit, physician, hospital, therapy,
        chemotherapy, antibiotic, pharmacy, midwife, paramedic, insulin, transplant, tumour, ward, symptome, krankenakte, krankenakten, dosierung, dosierungen,
        befund, befunde, allergie, allergien, impfstoff, impfstoffe, fieber, husten, wunde, patienten, arzt, ärztin, krankenhaus, diagnose, operationssaal,
        krankheit, dossier médical, dossiers médicaux, symptôme, vaccin, ordonnance, fièvre, toux, plaie, médecin, hôpital, infirmière, diagnostic, maladie,
        historia clínica, historias clínicas, vacuna, paciente, síntoma, alergia, receta médica, recetas médicas, diagnóstico, fiebre, tos, herida, médico,
        enfermera, enfermedad, medicine, medical, clinical, clinic, outpatient, inpatient, intensive care, emergency room, operating theatre, operating room,
        general practitioner, paediatrician, pediatrician, cardiologist, oncologist, neurologist, radiologist, psychiatrist, dermatologist, pathologist,
        anaesthetist, anesthesiologist, anesthetic, anesthesia, anaesthesia, surgical, incision, suture, bandage, sprain, x-ray image, mri, ct scan,
        electrocardiogram, ecg, ekg, stethoscope, syringe, catheter, ventilator, intravenous, iv drip, heart attack, cardiac, stroke patient, hypertension,
        diabetes, diabetic, asthma, pneumonia, bronchitis, influenza, measles, tuberculosis, sepsis, metastasis, tumor, benign, malignant, remission,
        chronic pain, migraine, headache, dizziness, vomiting, diarrhoea, diarrhea, inflammation, inflamed, immune system, antibody, antibodies, blood test,
        blood count, blood sample, blood sugar, haemoglobin, hemoglobin, cholesterol, platelets, painkiller, ibuprofen, paracetamol, penicillin, statin,
        beta blocker, side effect, contraindication, overdose, placebo, rehabilitation, physiotherapy, physiotherapist, prognosis, comorbidity, autopsy,
        epidemic, pandemic, quarantine, vaccination, immunisation, immunization, pregnancy, obstetrician, birth weight, dialysis, breathlessness,
        shortness of breath, pulse rate, palpitations, arrhythmia, medication, discharged home, medical history, dentist, caregiver, disease, illness, medizin,
        medizinisch, chirurg, chirurgin, krankenpfleger, krankenschwester, pflegekraft, hausarzt, hausärztin, notaufnahme, intensivstation, patientin,
        patientinnen, operation am herzen, narkose, blutdruck, blutprobe, blutwerte, blutzucker, herzinfarkt, herzrhythmus, schlaganfall, krebs, entzündung,
        infektion, infektionen, antibiotikum, antibiotika, impfung, impfungen, medikament, medikamente, tablette, tabletten, nebenwirkung, nebenwirkungen,
        kopfschmerzen, übelkeit, schwindel, ausschlag, atemnot, lungenentzündung, therapie, klinik, diagnosen, wunden, röntgenbild, niere, leber,
        zuckerkrankheit, sprechstunde, médecine, médical, médicale, chirurgien, chirurgienne, infirmier, patiente, urgences, soins intensifs, anesthésie,
        tension artérielle, prise de sang, analyse de sang, crise cardiaque, tumeur, antibiotique, médicament, comprimé, effet secondaire, effets secondaires,
        maux de tête, nausée, vertige, éruption cutanée, essoufflement, pneumonie, thérapie, clinique, radiographie, rein, foie, diabète, guérison,
        opération chirurgicale, consultation médicale, pansement, medicina, médica, cirujano, cirujana, enfermero, pacientes, urgencias, cuidados intensivos,
        anestesia, presión arterial, análisis de sangre, infarto, cáncer, inflamación, infección, antibiótico, vacunación, medicamento, pastilla,
        efecto secundario, efectos secundarios, dolor de cabeza, náuseas, mareo, erupción, neumonía, terapia, clínica, radiografía, riñón, hígado, quirófano,
        síntomas, dosis diaria, ritmo cardíaco, tratamiento
        ~ operation, scan, discharge, culture, cell, court, dose, dosis, operationen, operaciones, opération, rezept, rezepte, sample, reaction, history, record,
        chart, theatre, practice, solution, course, model, visit, doctor, nursing, cancer, wound, dolor, douleur, schmerzen, behandlung, operating, surgery,
        swelling, swollen, rash, liver, lung, lab, fracture, verband
        """,
    "finance": """
        credit line, tax return, invoice, key rate, interest rate, portfolio, balance sheet, broker, audit, hedge, dividend, currency, mortgage, revenue,
        inflation, savers, loan, withdrawal, depreciation, bookkeeper, investors, accounting, shareholder, creditor, stock exchange, treasury, bankruptcy,
        savings account, venture capital, ledger, holdings, anleihe, anleihen, devisen, rechnung, rechnungen, zins, zinsen, dividende, dividenden,
        steuererklärung, steuererklärungen, bilanz, bilanzen, kredit, kredite, konto, konten, darlehen, börse, aktie, aktien, sparer, umsatz, kontostand,
        devise, crédit, taux d'intérêt, bilan, déclaration fiscale, déclarations fiscales, facture, mensualité, compte bancaire, banque, trésorerie, dividendo,
        declaración fiscal, declaraciones fiscales, bono, crédito, factura, divisa, tipo de interés, tipos de interés, préstamo, banco, acciones, cuenta,
        cuentas, finance, financial, fiscal, fiscal year, fiscal quarter, quarterly results, quarterly report, earnings report, earnings per share,
        profit margin, gross margin, net income, operating income, cash flow, liquidity, solvency, insolvency, insolvent, bankrupt, liabilities, stock market,
        stock price, share price, shareholders, bond yield, treasury bond, government bond, coupon rate, maturity date, central bank, federal reserve,
        monetary policy, exchange rate, euro area, commercial bank, investment bank, banker, banking, bank account, bank transfer, bank statement,
        current account, overdraft, debit card, credit card, credit rating, credit score, lender, borrower, borrowing, repayment, instalment, installment,
        amortisation, amortization, compound interest, principal amount, collateral, refinancing, mortgage rate, hedge fund, mutual fund, index fund,
        pension fund, fund manager, private equity, asset manager, derivatives, futures contract, call option, put option, short selling,
        market capitalisation, market capitalization, initial public offering, ipo, prospectus, underwriter, takeover bid, bookkeeping, accountant, auditor,
        accounts payable, accounts receivable, payable, receivable, general ledger, write-off, tax authority, taxpayer, income tax, corporate tax,
        value-added tax, vat, deductible, capital gains, budget deficit, surplus, recession, insurance premium, premium income, payroll, invoicing,
        reimbursement, expense report, cost centre, stockbroker, trading floor, bull market, bear market, investor, investment, returns on capital,
        currency trader, foreign exchange, finanzen, finanziell, finanzamt, steuer, steuern, steuerberater, steuerberaterin, umsatzsteuer, einkommensteuer,
        gewinne, verluste, jahresabschluss, buchhaltung, buchhalter, buchhalterin, überweisung, überweisungen, zinssatz, leitzins, zentralbank, hypothek,
        hypotheken, sparkasse, girokonto, kreditkarte, tilgung, schulden, schuldner, gläubiger, insolvenz, investoren, anleger, wertpapier, wertpapiere,
        depot bei der bank, aktienkurs, aktienkurse, börsenschluss, währung, währungen, wechselkurs, rendite, haushalt des bundes, quartalszahlen,
        rechnungsprüfer, versicherungsprämie, finances, financier, financière, impôt, impôts, fiscalité, chiffre d'affaires, comptabilité, comptable, virement,
        taux directeur, banque centrale, hypothèque, prêt immobilier, prêt bancaire, emprunt, emprunteur, carte de crédit, dette, créancier, faillite,
        investisseur, investissement, fonds de placement, actionnaire, marché boursier, cours de bourse, monnaie, taux de change, rendement, épargne,
        épargnant, facturation, remboursement, trésorier, finanzas, financiero, financiera, impuesto, impuestos, hacienda, pérdida, ingresos, contabilidad,
        contable, transferencia bancaria, tipo de cambio, banco central, hipoteca, préstamo hipotecario, tarjeta de crédito, deuda, acreedor, quiebra,
        inversor, inversión, inversiones, fondo de inversión, accionista, mercado de valores, bolsa de valores, cotización, inflación, rentabilidad, ahorro,
        ahorros, ahorrador, facturación, reembolso, tesorería, interés compuesto
        ~ stock, share, bond, margin, deposit, default, yield, liability, index, settlement, transfer, filing, record, obligation, obligations, note, scale,
        interest, quarter, fee, key, issue, draft, principal, option, return, float, statement, cours, bourse, cash, assets, equity, profit, gewinn, verlust,
        savings, perte, deposits, rate, raten, moneda, seguro, assurance, returns, balance, budget, payment, bank, action, comptes, merger, acquisition,
        deduction, premium, volatility, earnings, buchung, kurse, trimestre, quartal, beneficio, bénéfice, fonds
        """,
    "transport": """
        lorry, lorries, depot, tram, customs, ferry, ferries, axle, detour, pallet, freight train, harbour, signal box, timetable, runway, branch line,
        passengers, barge, motorway, wagons, derailed, aircraft, freight, railway, locomotive, airport, shipping line, truck, highway, toll, forwarder,
        commuter, gauge, umleitung, umleitungen, hafen, häfen, güterzug, güterzüge, palette, paletten, bahnsteig, bahnsteige, fähre, fähren, fahrplan,
        fahrpläne, fracht, frachten, lastwagen, autobahn, fahrer, bahnhof, flughafen, schiene, spedition, train de marchandises, trains de marchandises, quai,
        déviation, camion, cargaison, autoroute, chauffeur, gare, aéroport, fret, palé, palés, transbordador, transbordadores, tren de mercancías,
        trenes de mercancías, camión, camiones, desvío, andén, andenes, puerto, autopista, autobús, conductor, cargas, aeropuerto, estación, transportation,
        logistics, traffic jam, congestion, roadworks, roundabout, intersection, overpass, bypass, freeway, carriageway, lane closure, speed limit,
        driving licence, truck driver, lorry driver, bus driver, train driver, bus stop, bus line, bus route, bus lane, coach station, tram stop, tramway,
        subway, underground train, metro line, light rail, rail freight, train station, railway station, express train, night train, level crossing,
        rail traffic, signalman, overhead line, shunting, locomotives, wagon, sleeper train, derailment, courier, consignment, shipment, shipping container,
        container ship, cargo ship, freighter, tanker, tugboat, docks, dockworker, quay, berth, lighthouse, lock keeper, barges, seaport, port authority,
        ferry terminal, airline, airliner, airplane, aeroplane, co-pilot, cockpit, air traffic control, control tower, taxiway, emergency landing, take-off,
        takeoff, landing gear, jet fuel, boarding gate, baggage, luggage, layover, stopover, stewardess, cabin crew, helicopter, delivery van, loading bay,
        loading dock, forklift, semi-trailer, tachograph, driving time, haulage, haulier, customs clearance, customs officer, bill of lading, waybill, pallets,
        fleet operator, bicycle lane, cycle lane, bike lane, pedestrian, electric bus, diesel, fuel tank, tollgate, toll road, commuter train, arrivals board,
        delayed train, rush hour, passenger, straßenverkehr, stau, straße, straßen, kreuzung, baustelle, busse, buslinie, bushaltestelle, haltestelle,
        haltestellen, straßenbahn, straßenbahnen, u-bahn, s-bahn, gleis, gleise, weiche, weichen, lokomotive, lokführer, lokführerin, schaffner, fahrgast,
        fahrgäste, busfahrer, lkw, lkw-fahrer, transporter, lieferungen, spediteur, schiff, schiffe, frachter, containerschiff, kapitän, kai, schleuse,
        flugzeug, flugzeuge, flüge, pilotin, landebahn, startbahn, notlandung, gepäck, zoll, lenkzeit, maut, verspätungen, abfahrt, ankunft, lagerhalle,
        embouteillage, bouchon, carrefour, rond-point, travaux routiers, autobus, arrêt de bus, ligne de bus, métro, voie ferrée, aiguillage,
        conducteur de train, cheminot, passager, voyageur, poids lourd, routier, livraison, expédition, navire, bateau, porte-conteneurs, capitaine, écluse,
        avion, pilote, piste d'atterrissage, atterrissage, décollage, bagages, douane, péage, correspondance, entrepôt, marchandise, transporteur,
        chemin de fer, transporte, atasco, carretera, cruce, rotonda, obras en la carretera, parada de autobús, línea de autobús, tranvía, tren, trenes,
        vía férrea, locomotora, maquinista, pasajero, viajero, camionero, envío, mercancía, mercancías, barco, buque, carguero, portacontenedores, capitán,
        muelle, esclusa, avión, aviones, piloto, pista de aterrizaje, aterrizaje, despegue, equipaje, aduana, peaje, transbordo, almacén, transportista,
        ferrocarril, furgoneta
        ~ container, platform, track, coach, fleet, port, dispatch, horaire, horaires, horario, horarios, carga, scale, line, bus, driver, branch, transfer,
        brake, delivery, coupling, switch, points, slope, border, boat, road, pilot, flight, captain, crew, ship, vessel, rail, train, trains, route, vol,
        vuelo, zug, züge, flug, bahn, crossing, dock, carriage, vehicle, plane, departure, parking, retard, retraso, verspätung, transport, traffic, tráfico,
        verkehr, circulation, lieferung, sendung, paquete, colis, paket, pakete, metro, trailer, kanal, shipping, taxi, canal, parcel, van, warehouse, cargo
        """,
    "education": """
        lecture, pupil, curriculum, textbook, classroom, report card, essay, enrolment, syllabus, seminar, semester, scholarship, homework, tutor, key stage,
        university, first-graders, kindergarten, undergraduate, headmaster, diploma, tuition, exam, dissertation, lesson, schüler, schülerin, lehrbuch,
        lehrbücher, vorlesung, vorlesungen, prüfung, prüfungen, hausaufgabe, hausaufgaben, stipendium, stipendien, seminare, lehrplan, lehrpläne, universität,
        lehrerin, lehrer, schule, unterricht, studium, klassenzimmer, manuel, élève, programme scolaire, programmes scolaires, séminaire, cours magistral,
        cours magistraux, examen, maîtresse, université, école, professeur, bourse d'études, devoirs, cahier, alumno, alumna, seminario, exámenes, deberes,
        plan de estudio, planes de estudio, beca, calificación, calificaciones, clase magistral, clases magistrales, libro de texto, libros de texto, maestra,
        maestro, universidad, escuela, profesor, education, educational, teacher, students, schoolchild, schoolchildren, schoolboy, schoolgirl, primary school,
        elementary school, middle school, secondary school, high school, grammar school, boarding school, nursery school, preschool, first-grader, sixth form,
        campus, lecturer, lecture hall, dean, principal's office, headteacher, head teacher, headmistress, teaching assistant, substitute teacher,
        school board, school year, school bus trip, academic year, summer school, term paper, bachelor's degree, master's degree, phd, doctorate, postgraduate,
        graduation, alumni, oral exam, final exam, entrance exam, midterm, examiner, multiple-choice, pass mark, marking scheme, gradebook, failing grade,
        school grades, essay question, reading comprehension, spelling test, multiplication table, long division, arithmetic, handwriting, reading aloud,
        dictation, vocabulary test, foreign language class, algebra class, blackboard, whiteboard, chalk, school bag, satchel, pencil case, exercise book,
        worksheet, lesson plan, learning objective, coursework, tutoring, mentoring, literacy, numeracy, pedagogy, pedagogical, special needs,
        parents' evening, parent-teacher, truancy, field trip, school holidays, summer holidays, playground, school library, admissions office, apprenticeship,
        vocational training, apprentice, bildung, lehrkraft, lehrkräfte, lehrerzimmer, grundschule, realschule, gesamtschule, hochschule, schulhof,
        schulleiter, schulleiterin, schuljahr, schulklasse, klassenarbeit, klassenarbeiten, klassenfahrt, abitur, zeugnis, zeugnisse, schulnote, schulnoten,
        studentin, studenten, studierende, professorin, dozent, dozentin, hörsaal, bachelorarbeit, masterarbeit, doktorarbeit, promotion an der universität,
        aufsatz, aufsätze, diktat, schulferien, sommerferien, kreide, nachhilfe, auszubildende, auszubildender, schulbuch, schulbücher, schülerinnen,
        schulkinder, schulkind, unterrichtsstunde, einschulung, mündliche prüfung, studiengang, éducation, enseignement, enseignant, enseignante, institutrice,
        instituteur, étudiant, étudiante, écolier, écolière, lycée, lycéen, collégien, école primaire, maternelle, rentrée scolaire, année scolaire,
        vacances scolaires, salle de classe, tableau noir, craie, baccalauréat, bulletin scolaire, dictée, rédaction, mémoire de master, thèse, doctorat,
        amphithéâtre, professeure, soutien scolaire, apprenti, directrice de l'école, proviseur, récréation, épreuve orale, semestre, diplôme,
        manuels scolaires, educación, enseñanza, docente, profesora, estudiante, estudiantes, alumnos, alumnas, colegio, instituto de secundaria,
        escuela primaria, jardín de infancia, curso escolar, año escolar, vacaciones escolares, aula, pizarra, tiza, bachillerato, boletín de notas, dictado,
        redacción escolar, tesis, doctorado, catedrático, catedrática, clases particulares, aprendiz, directora del colegio, recreo, examen oral, lecciones,
        matrícula, asignatura, asignaturas, cuaderno
        ~ course, grade, term, class, coach, note, notes, noten, test, bourses, bourse, lessons, degree, subject, paper, draft, mark, marks, school, model,
        period, board, devoir, record, score, scale, teaching, taught, learning, learner, graduate, graduates, college, faculty, fractions, spelling,
        admission, assignment, tafel, detention, geometry, principal, promotion, examination, student, thesis, leçon, lección, quiz, poem, professor,
        gymnasium, beginner, ausbildung, collège, apprentissage, aprendizaje
        """,
    "music": """
        bass line, drummer, chord, melody, melodies, harmony, harmonies, string section, tempo, refrain, overture, choir, rehearsal, guitar, pianist, waltz,
        piano, brass, violin, singer, opera, drum roll, cello, cellos, orchestra, symphony, sonata, trumpet, soprano, saxophone, concerto, songwriter, quartet,
        chor, chöre, akkord, akkorde, taktwechsel, melodie, melodien, geige, geigen, partitur, partituren, kapelle, trommel, trommeln, celli, sängerin, sänger,
        klavier, orchester, oper, chœur, choeur, mélodie, orchestre, accord, tambour, violon, partition, chanteuse, chanteur, chanson, violoncelle, opéra,
        acorde, orquesta, partitura, tambor, tambores, melodía, coro, estribillo, violín, violines, violonchelo, compás, cantante, canción, ópera, music,
        musical, musician, composer, songwriting, song, lyrics, verse and chorus, ballad, album cover, studio album, debut album, live album, recording studio,
        sound engineer, mixing desk, record label, vinyl, playlist, concert hall, recital, gig, festival stage, bandleader, rock band, jazz, blues, hip-hop,
        folk song, pop song, gospel, techno, reggae, baroque, fugue, prelude, nocturne, etude, cantata, oratorio, requiem, aria, libretto, lullaby, march tune,
        string quartet, guitarist, bassist, violinist, cellist, trumpeter, saxophonist, organist, flautist, flutist, harpist, percussionist, vocalist, tenor,
        baritone, mezzo-soprano, choirmaster, choral, concertmaster, maestro, double bass, flute, clarinet, oboe, bassoon, french horn, trombone, harpsichord,
        organ pipes, banjo, ukulele, mandolin, accordion, harmonica, synthesizer, keyboard player, bagpipes, xylophone, timpani, cymbal, snare drum, bass drum,
        drum kit, drumming, drumstick, woodwind, brass section, rhythm section, guitar solo, guitar string, acoustic guitar, electric guitar, metronome,
        tuning fork, sheet music, music stand, time signature, key signature, treble clef, bass clef, crotchet, quaver, semitone, octave, major chord,
        minor chord, major key, minor key, a minor, c major, g major, d minor, arpeggio, crescendo, diminuendo, fortissimo, pianissimo, staccato, legato,
        vibrato, pizzicato, syncopation, syncopated, counterpoint, dissonance, rhythmic, downbeat, beat per minute, beats per minute, intonation, singing,
        improvisation, improvise, musik, musiker, musikerin, komponist, komponistin, konzert, konzerte, konzertsaal, lied, lieder, liedtext, sopran, bariton,
        dirigent, dirigentin, sinfonie, symphonie, streichquartett, bratsche, kontrabass, flöte, flöten, klarinette, fagott, trompete, trompeten, posaune,
        harfe, orgel, gitarre, gitarren, schlagzeug, schlagzeuger, pianistin, geiger, geigerin, bläser, streicher, noten lesen, tonart, tonleiter, moll,
        rhythmus, takte, oktave, terz, quinte, plattenfirma, strophe, gesang, singt, singen, chorprobe, orchesterprobe, metronom, musique, musicien,
        musicienne, compositeur, compositrice, chanter, paroles de la chanson, ténor, baryton, chef d'orchestre, quatuor, quatuor à cordes, contrebasse, flûte,
        clarinette, hautbois, basson, trompette, harpe, orgue, guitare, guitariste, batteur, pianiste, violoniste, tonalité, rythme, tierce, couplet, solfège,
        choriste, chorale, chante, valse, cuivres, percussions, fausse note, música, músico, músicos, compositor, compositora, concierto, cantar,
        letra de la canción, barítono, director de orquesta, sinfonía, cuarteto, cuarteto de cuerda, contrabajo, flauta, clarinete, fagot, trompeta, trombón,
        arpa, guitarra, guitarrista, baterista, pianista, violinista, tonalidad, escala musical, ritmo, octava, estrofa, solfeo, canta, vals, percusión,
        melodías, acordes
        ~ bar, scale, key, score, solo, suite, noten, movement, conductor, reed, note, record, release, pitch, string, répétition, répétitions, ensayo, ensayos,
        interval, track, session, bench, accords, album, batch, sharp, flat, rest, staff, stand, band, alto, tune, tuned, composition, composed, rhythm,
        cadence, modulation, harp, chorus, amplifier, horn, dur, órgano, organ, viola, beat, metales, gamme, sing, sings, sang, sung, batterie, batería,
        concert, upbeat, tuba, klang, measure, encore
        """,
    "food": """
        whisk, vinegar, sauce, spice, yeast, dough, butter, oven, crumb, broth, olives, lemon, potatoes, onions, cheese, yoghurt, egg whites, bake,
        medium heat, flour, sugar, cinnamon, roast, bakery, dessert, vegetables, garlic, restaurant, vineyard, kitchen, speisekarte, speisekarten, backofen,
        backöfen, soße, soßen, teig, teige, gewürz, gewürze, hefe, hefen, brühe, brühen, eiweiß, unterheben, zwiebeln, küche, mehl, zucker, käse, kochen,
        bouillon, pâte à pain, pâtes à pain, épice, levure, oignons, blancs en neige, cuire, cuisine, farine, beurre, sucre, fromage, boulangerie,
        recette de cuisine, masa, horno, salsa, menú, menús, especia, levadura, caldo, receta de cocina, recetas de cocina, cebollas, hornear, cocina, harina,
        mantequilla, azúcar, queso, food, recipe book, cookbook, cooking, chef, sous-chef, culinary, gastronomy, ingredient, tablespoon, teaspoon, saucepan,
        frying pan, skillet, baking tray, baking sheet, baking powder, baking soda, rolling pin, cutting board, chopping board, colander, sieve, ladle,
        spatula, casserole, stew, stewed, stock pot, gravy, marinade, marinate, marinated, braise, braised, simmer, simmering, saute, sauté, fry, fried,
        deep-fried, grilled, roasted, boiled, boiling water, steam the, poached, blanch, knead, kneading, proofing, sourdough, baguette, pastry, puff pastry,
        shortcrust, sponge cake, muffin, biscuit, pancake, waffle, pudding, custard, whipped cream, ice cream, chocolate, vanilla, honey, syrup, caramel,
        meringue, egg yolk, egg white, cream cheese, mozzarella, parmesan, cheddar, goat cheese, rennet, curd, whey, cheesecloth, buttermilk, risotto, pasta,
        spaghetti, noodle, dumpling, lasagne, lasagna, pizza, salad, lettuce, cucumber, tomato, tomatoes, potato, carrot, onion, shallot, leek, celery,
        spinach, cabbage, mushroom, zucchini, aubergine, eggplant, bell pepper, chilli, chili, basil, parsley, thyme, rosemary, oregano, coriander, cilantro,
        cumin, paprika, turmeric, saffron, nutmeg, clove of garlic, ginger, mustard, mayonnaise, ketchup, soy sauce, olive oil, sunflower oil, pinch of salt,
        seasoning, savory, savoury, lentil, chickpea, tofu, meat, beef, pork, lamb, chicken, sausage, bacon, salmon, trout, cod, tuna, shrimp, prawn, mussel,
        oyster, pear, cherry, strawberry, raspberry, orange juice, lemon juice, lime juice, almonds, walnut, hazelnut, cider, brewery, brewing, breakfast,
        lunch menu, supper, appetiser, appetizer, waiter, waitress, leftovers, fermented, pickled, oven-baked, fridge, refrigerator, vegetarian, vegan,
        lebensmittel, koch, köchin, zutat, zutaten, esslöffel, teelöffel, pfanne, pfannen, töpfe, kochtopf, braten, brot, brote, brötchen, kuchen, torte,
        gebäck, bäcker, bäckerin, bäckerei, kneten, suppe, suppen, eintopf, salat, salate, gemüse, kartoffel, kartoffeln, karotten, möhren, zwiebel, knoblauch,
        tomaten, pilze, petersilie, pfeffer, salz, essig, olivenöl, sahne, milch, quark, joghurt, eier, eigelb, eischnee, fleisch, rindfleisch,
        schweinefleisch, hähnchen, wurst, schinken, fisch, forelle, lachs, reis, nudeln, linsen, bohnen, obst, apfel, äpfel, birne, zitrone, zitronen, honig,
        schokolade, marmelade, wein, bier, kaffee, frühstück, mittagessen, abendessen, nachtisch, gasthaus, kellner, kellnerin, schmoren, köcheln, würzen,
        backen, gebacken, ofen, sauerteig, nourriture, cuisinier, cuisinière, ingrédient, cuillère à soupe, cuillère à café, poêle, marmite, pains, gâteau,
        pâtisserie, pâtissier, boulanger, pétrir, soupe, salade, légume, pomme de terre, pommes de terre, carotte, oignon, gousse d'ail, tomate, champignon,
        persil, poivre, vinaigre, huile d'olive, crème fraîche, lait, yaourt, œuf, œufs, oeufs, jaune d'œuf, viande, bœuf, porc, poulet, saucisse, jambon,
        poisson, truite, saumon, riz, pâtes fraîches, lentilles, haricots, pomme, poire, citron, chocolat, confiture, vin, bière, café, petit-déjeuner,
        déjeuner, dîner, serveur de restaurant, mijoter, assaisonner, au four, levain, pâte brisée, pâte feuilletée, cuisson, comida, cocinero, cocinera,
        ingrediente, ingredientes, cucharada, cucharadita, sartén, olla, cazuela, tarta, repostería, panadero, panadería, amasar, sopa, ensalada, verdura,
        verduras, patata, patatas, zanahoria, cebolla, diente de ajo, setas, perejil, pimienta, vinagre, aceite de oliva, nata, leche, yogur, huevo, huevos,
        yema, clara de huevo, claras de huevo, carne, ternera, cerdo, pollo, salchicha, jamón, pescado, trucha, salmón, arroz, fideos, lentejas, judías,
        manzana, limón, mermelada, vino, cerveza, desayuno, almuerzo, cena, postre, camarero, guisar, sazonar, masa madre, fuego lento, freír, hervir
        ~ starter, stock, course, recipe, recette, recettes, harvest, menu, cellar, batch, reduction, ernte, ernten, récolte, récoltes, cosecha, cosechas,
        culture, bar, serving, port, scale, pitch, cell, season, yield, solution, suspended, menus, cook, salt, salted, pie, cookie, fish, fruit, apple,
        pepper, tea, ham, sweet, sour, bitter, tart, jam, bun, cake, steam, bread, loaf, milk, turkey, poach, boil, eggs, pan, sel, sal, ail, pain, tarte,
        pera, pastel, öl, topf, geschmack, beans, smoked, dinner, lunch, clove, rind, diner, icing, grill, soup, ripening, pickle, wine, beer, coffee,
        fermentation, rice, clara, ajo, miel, four
        """,
}
