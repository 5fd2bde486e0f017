"""Words and dialects of the languages that sources are read in."""

# Words of the languages.
RESERVED = """break case catch class const continue debugger default delete do else enum export extends false finally for function if import in
    instanceof new null return super switch this throw true try typeof var void while with""".split()
STRICT = "implements interface let package private protected public static yield await".split()
CONTEXTUAL = """abstract accessor as assert asserts async constructor declare from get global infer is keyof module namespace of out override readonly
    require satisfies set type unique using""".split()
#: (whether types, whether elements are read) by dialect.
DIALECTS = {"javascript": (False, False), "jsx": (False, True), "typescript": (True, False), "tsx": (True, True)}
