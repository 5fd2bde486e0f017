"""The bundled grammars: ECMAScript modules with JSX and TypeScript where the dialect has them, and strict JSON.

They accept all valid texts; where validity needs more than syntax of tokens (early errors), ``js_parser`` looks again.
"""

from thicket.parse.words import CONTEXTUAL, RESERVED, STRICT

# Operators of the languages.
ASSIGN = "= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split()
BINARY = "+ - * / % ** == != === !== < <= >= << && || ?? & | ^ in instanceof".split()

SETS = {
    "Ident": ["ID", *CONTEXTUAL],
    "Name": ["ID", *RESERVED, *STRICT, *CONTEXTUAL],
    "Assign": ASSIGN,
    "Binary": BINARY,
    "Unary": ["delete", "void", "typeof", "+", "-", "~", "!", "await", "++", "--"],
    "Step": ["++", "--"],
    "Access": ["public", "private", "protected", "readonly", "override"],
    "Member": ["static", "async", "accessor", "public", "private", "protected", "readonly", "abstract", "override", "declare"],
    "AfterName": ["(", "=", ";", "}", ":", "?", "!", ",", "<", "EOF"],
    "AfterTypeArgs": ["(", "TPL", "TPLH", ")", "]", ",", ";", ":", "}", "EOF"],
    "Sub": ["const", "class", "let"],
    "TypeStart": ["ID", *CONTEXTUAL, "(", "[", "{", "STR", "NUM", "-", "TPL", "TPLH", "true", "false", "null", "void", "this", "typeof", "import", "new", "<", "const"],
    "Literal": ["STR", "NUM", "true", "false", "null"],
}

MODULE = r"""
Module: Item* 'EOF'
Item: Import | Export | Stmt
Import: 'import' ( 'STR' With? Semi
    | %ts @Ident '=' ( 'require' '(' 'STR' ')' | Dotted ) Semi
    | %ts 'type' @Ident '=' 'require' '(' 'STR' ')' Semi
    | %ts 'type' ImportClause 'from' 'STR' With? Semi
    | ImportClause 'from' 'STR' With? Semi )
With: ( 'with' | 'assert' ) '{' ( WithEntry ( ',' WithEntry )* ','? )? '}'
WithEntry: ( @Name | 'STR' ) ':' 'STR'
ImportClause: ImportNames | '*' 'as' @Ident | @Ident ( ',' ( ImportNames | '*' 'as' @Ident ) )?
ImportNames: '{' ( ImportName ( ',' ImportName )* ','? )? '}'
ImportName: ( @Name | 'STR' ) 'as' @Ident &ListEnd | @Ident &ListEnd | %ts 'type' ( @Name | 'STR' ) ( 'as' @Ident )?
ListEnd: ',' | '}'
Dotted: @Ident ( '.' @Name )*
Export: Decorator* 'export' ( '*' ( 'as' ( @Name | 'STR' ) )? 'from' 'STR' With? Semi
    | 'default' Default
    | ExportNames ( 'from' 'STR' With? )? Semi
    | %ts 'type' ExportNames ( 'from' 'STR' With? )? Semi
    | %ts 'type' '*' ( 'as' @Name )? 'from' 'STR' With? Semi
    | %ts '=' Expr Semi
    | %ts 'as' 'namespace' @Ident Semi
    | %ts Import
    | Decl )
Default: Function | Class | %ts 'abstract' Class | %ts Interface | Assign Semi
ExportNames: '{' ( ExportName ( ',' ExportName )* ','? )? '}'
ExportName: ( @Name | 'STR' ) ( 'as' ( @Name | 'STR' ) )? &ListEnd | %ts 'type' @Name ( 'as' @Name )?
Decl: %ts TsDecl | Lexical | NamedFunction | NamedClass
Lexical: 'const' !'enum' ConstBinding ( ',' ConstBinding )* Semi | ( 'var' | 'let' ) Binding ( ',' Binding )* Semi | ( 'await' %nl )? 'using' %nl @Ident Init ( ',' @Ident Init )* Semi
ConstBinding: Pattern Ann? Init | %ts @Ident Ann
Binding: BindingPattern Ann? Init | @Ident ( %ts '!' )? Ann? Init?
BindingPattern: ArrayPattern | ObjectPattern
Pattern: @Ident | ArrayPattern | ObjectPattern
ArrayPattern: '[' ArrayHole? ( ',' ArrayHole? )* ']'
ArrayHole: '...' Pattern | Pattern Init?
ObjectPattern: '{' ( PropPattern ( ',' PropPattern )* ','? )? '}'
PropPattern: '...' Pattern | PropName ':' Pattern Init? | @Ident Init?
Init: '=' Assign
Ann: %ts ':' Type
Stmt: Block | ';' | Lexical | %ts TsDecl | NamedFunction | NamedClass | If | For | While | Do | Return | Jump | Throw | Try | Switch | 'debugger' Semi | Label | !'function' !'class' !'{' Expr Semi
Semi: ';' | %asi
Sep: ';' | ',' | %asi
Block: '{' Stmt* '}'
Sub: !@Sub Stmt
If: 'if' '(' Expr ')' Sub ( 'else' Sub )?
For: 'for' 'await'? '(' ( ForOf | ForIn | ( ForVar | Expr )? ';' Expr? ';' Expr? ) ')' Loop
Loop!: Sub
ForOf: ( ( 'var' | 'let' | 'const' ) Pattern Ann? | 'await'? 'using' !'of' @Ident | Call ) 'of' Assign
ForIn: ( ( 'var' | 'let' | 'const' ) Pattern Ann? | Call ) 'in' Expr
ForVar: ( 'var' | 'let' | 'const' ) Pattern Ann? Init? ( ',' Pattern Ann? Init? )*
While: 'while' '(' Expr ')' Loop
Do: 'do' Loop 'while' '(' Expr ')' ';'?
Return!: 'return' ( %nl !';' Expr )? Semi
Jump!: ( 'break' | 'continue' ) ( %nl @Ident )? Semi
Throw: 'throw' %nl Expr Semi
Try: 'try' Block ( 'catch' ( '(' Pattern Ann? ')' )? Block ( 'finally' Block )? | 'finally' Block )
Switch: 'switch' '(' Expr ')' Cases
Cases!: '{' ( ( 'case' Expr | 'default' ) ':' Stmt* )* '}'
Label: @Ident ':' Stmt
Body!: '{' Stmt* '}'
NamedFunction: ( 'async' %nl )? 'function' '*'? @Ident Signature FunctionEnd
Function: ( 'async' %nl )? 'function' '*'? @Ident? Signature FunctionEnd
FunctionEnd: Body | %ts Semi
FunctionExpr: ( 'async' %nl )? 'function' '*'? ( @Ident | 'yield' | 'await' )? Signature Body
Signature: TypeParams? Params Returned?
Params: '(' ( Param ( ',' Param )* ','? )? ')'
Param: Decorator* ( %ts @Access !@AfterName )* ( '...' Pattern Ann? | Pattern ( %ts '?' )? Ann? Init? | %ts 'this' Ann? )
NamedClass: Decorator* 'class' @Ident ClassRest
Class: Decorator* 'class' @Ident? ClassRest
ClassRest: TypeParams? ( 'extends' Call TypeArgs? )? ( %ts 'implements' TypeRefs )? '{' Element* '}'
Element: ';' | 'static' Body | Decorator* ( %member @Member !@AfterName )* ( %ts Index | ( 'get' | 'set' ) !@AfterName PropName Signature MethodEnd
    | '*' PropName Signature MethodEnd | PropName ( %ts ( '?' | '!' ) )? ( Signature MethodEnd | Ann? Init? Semi ) )
MethodEnd: Body | %ts Semi
Index: '[' @Ident ':' Type ']' Ann? Semi
Decorator: '@' ( '(' Expr ')' | @Ident ( '.' ( @Name | 'PRIV' ) )* ( %ts TypeArgs )? Args? )
PropName: @Name | 'STR' | 'NUM' | '[' Assign ']' | 'PRIV'
Expr: Assign ( ',' Assign )*
Assign: %arrow Arrow | 'yield' ( %nl '*'? Assign )? | Operation ( '?' Assign ':' Assign | @Assign Assign )?
Arrow!: ( 'async' %nl )? ( @Ident | TypeParams? Params Returned? ) %nl '=>' ( Body | !'{' Assign )
Operation: Unary ( @Binary Unary | '>' ( %adjacent '>' ( %adjacent '>' )? )? Unary | %ts %nl ( 'as' | 'satisfies' ) Type )*
Unary: @Unary* ( %assertion '<' Type '>' Unary | Call ( %nl @Step )? )
Call: Primary Suffix*
Suffix: '.' ( @Name | 'PRIV' ) | '[' Expr ']' | Args | 'TPL' | Template | %ts %nl '!' | %ts TypeArgs &@AfterTypeArgs
    | '?.' ( Args | '[' Expr ']' | @Name | 'PRIV' | %ts TypeArgs Args )
Args: '(' ( Arg ( ',' Arg )* ','? )? ')'
Arg: '...'? Assign
Template: 'TPLH' Expr ( 'TPLM' Expr )* 'TPLT'
Primary: @Ident !( '=>' | %nl 'function' ) | 'NUM' | 'STR' | 'TPL' | Template | 'REGEX' | 'this' | 'super' &( '.' | '(' | '[' ) | 'null' | 'true' | 'false' | '(' Expr ')' | List | Object
    | FunctionExpr | Class | New | 'import' ( '.' @Name | Args ) | 'PRIV' &'in' | Element_
List: '[' Arg? ( ',' Arg? )* ']'
Object: '{' ( Prop ( ',' Prop )* ','? )? '}'
Prop: '...' Assign | PropName ( ':' Assign | Signature Body ) | ( 'get' | 'set' ) !@AfterName PropName Signature Body
    | 'async' %nl !@AfterName '*'? PropName Signature Body | '*' PropName Signature Body | @Ident Init? &ListEnd
New: 'new' ( '.' @Name | ( New | Primary ) NewSuffix* ( %ts TypeArgs )? Args? )
NewSuffix: '.' ( @Name | 'PRIV' ) | '[' Expr ']' | 'TPL' | Template | %ts %nl '!'
Element_: '<J' ( '>J' Child* '</J' '>J' | TagName ( %ts TypeArgs )? Attribute* ( '/>J' | '>J' Child* '</J' TagName '>J' ) )
TagName: 'JNAME' ( ( '.J' | ':J' ) 'JNAME' )*
Attribute: '{' '...' Assign '}' | 'JNAME' ( ':J' 'JNAME' )? ( '=J' ( 'JSTR' | '{' Expr '}' | Element_ ) )?
Child: 'JTEXT' | '{' ( '...'? Expr )? '}' | Element_
Returned: %ts ':' ReturnType
ReturnType: 'asserts' %nl ( @Ident | 'this' ) ( 'is' Type )? | ( @Ident | 'this' ) %nl 'is' Type | Type
Type!: %functype 'abstract'? 'new'? TypeParams? Params '=>' ReturnType | Union ( %nl 'extends' Bound '?' Type ':' Type )?
Bound: %functype 'abstract'? 'new'? TypeParams? Params '=>' ReturnType | '|'? BoundInter ( '|' BoundInter )*
BoundInter: '&'? BoundPart ( '&' BoundPart )*
BoundPart: 'infer' @Ident ( 'extends' Bound )? &BoundEnd | Postfixed
BoundEnd: '?' | '|' | '&'
Union: '|'? Inter ( '|' Inter )*
Inter: '&'? Postfixed ( '&' Postfixed )*
Postfixed: ( ( 'keyof' | 'unique' | 'readonly' ) &@TypeStart )* ( 'infer' @Ident ( 'extends' Union !'?' )? | TypeAtom ) ( %nl '[' Type? ']' )*
TypeAtom: %functype FunctionType | '(' Type ')' | '[' ( TupleItem ( ',' TupleItem )* ','? )? ']' | Mapped | TypeObject | 'STR' | '-'? 'NUM' | 'TPL' | 'TPLH' Type ( 'TPLM' Type )* 'TPLT'
    | 'true' | 'false' | 'null' | 'void' | 'this' | 'const' | 'typeof' ( ImportType | @Name ( '.' ( @Name | 'PRIV' ) )* TypeArgsHere? ) | ImportType | Dotted TypeArgsHere?
FunctionType: 'new'? TypeParams? Params '=>' ReturnType
ImportType: 'import' '(' Type ( ',' Object )? ')' ( '.' @Name )* TypeArgs?
TypeArgsHere: %nl TypeArgs
TypeArgs!: '<' Type ( ',' Type )* ','? '>'
TypeParams: %ts '<' TypeParam ( ',' TypeParam )* ','? '>'
TypeParam: ( ( 'const' | 'in' | 'out' ) &@Name )* @Ident ( 'extends' Type )? ( '=' Type )?
TypeRefs: TypeRef ( ',' TypeRef )*
TypeRef: Dotted TypeArgs?
TupleItem: '...'? @Name '?'? ':' Type | '...'? Type '?'?
Mapped: '{' ( ( '+' | '-' )? 'readonly' )? '[' @Ident 'in' Type ( 'as' Type )? ']' ( ( '+' | '-' )? '?' )? ( ':' Type )? ( ';' | ',' )? '}'
TypeObject: '{' ( TypeMember Sep )* '}'
TypeMember: ( ( 'readonly' | 'static' ) !@AfterName )? ( '[' @Ident ':' Type ']' Ann? | ( 'get' | 'set' ) !@AfterName PropName Params Returned? | 'new' Signature | PropName '?'? ( Signature | Ann? ) | Signature )
TsDecl: Interface | Alias | Enum | Space | 'declare' %nl ( 'global' Block_ | Ambient | TsDecl | NamedFunction | 'abstract'? NamedClass ) | 'abstract' %nl NamedClass
Ambient: ( 'var' | 'let' | 'const' ) !'enum' Pattern Ann? Init? ( ',' Pattern Ann? Init? )* Semi
Interface: 'interface' @Ident TypeParams? ( 'extends' TypeRefs )? TypeObject
Alias: 'type' %nl @Ident TypeParams? '=' Type Semi
Enum: 'const'? 'enum' @Ident '{' ( EnumItem ( ',' EnumItem )* ','? )? '}'
EnumItem: ( @Name | 'STR' | '[' Assign ']' ) Init?
Space: ( 'namespace' | 'module' ) %nl ( Dotted | 'STR' ) ( Block_ | Semi )
Block_: '{' Item* '}'
"""

JSON = r"""
Text: Value 'EOF'
Value: '{' ( Pair ( ',' Pair )* )? '}' | '[' ( Value ( ',' Value )* )? ']' | @Literal
Pair: 'STR' ':' Value
"""
