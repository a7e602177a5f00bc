"""The bundled grammars.

Expressions are flat: an operand, then operators with operands. Precedence has no bearing on
whether a text is valid, and a flat rule keeps the machine's work per token small.
"""

GO = r"""
File: 'package' IDENT ';' (Import ';' CUT)* (Top ';' CUT)* EOF ;
Import: 'import' (ImportSpec | '(' (ImportSpec Sep)* ')') ;
ImportSpec: ('.' | IDENT)? STRING ;
Sep: ';' | &closing ;
Top: 'func' (Params IDENT | IDENT TypeParams?) Signature Block? | Decl ;
Decl: 'const' (ConstSpec | '(' (ConstSpec Sep)* ')') | 'var' (VarSpec | '(' (VarSpec Sep)* ')') | 'type' (TypeSpec | '(' (TypeSpec Sep)* ')') ;
ConstSpec: Names (Type? '=' Exprs)? ;
VarSpec: Names (Type ('=' Exprs)? | '=' Exprs) ;
TypeSpec: IDENT TypeParams Type | IDENT '='? Type ;
Names: IDENT (',' IDENT)* ;
TypeParams: '[' TypeParam (',' TypeParam)* ','? ']' ;
TypeParam: Names Union ;
Union: '~'? Type ('|' '~'? Type)* ;
Signature: Params Result? ;
Result: Params | Type ;
Params: '(' (Param (',' Param)* ','?)? ')' ;
Param: IDENT '...'? Type | '...'? Type ;
Type: TypeName | '*' Type | '[' ']' Type | '[' ('...' | Expr) ']' Type | 'map' '[' Type ']' Type | Chan | 'func' Signature | Struct | Interface | '(' Type ')' ;
TypeName: IDENT ('.' IDENT)? ('[' Type (',' Type)* ','? ']')? ;
Chan: 'chan' '<-'? Type | '<-' 'chan' Type ;
Struct: 'struct' '{' (Field Sep)* '}' ;
Field: Names Type STRING? | '*'? TypeName STRING? ;
Interface: 'interface' '{' (Elem Sep)* '}' ;
Elem: IDENT Signature | Union ;
Block: '{' Stmts '}' ;
Stmts: (';' | Stmt End)* ;
End: ';' CUT | &closing ;
Stmt: Decl | 'return' Exprs? | 'break' IDENT? | 'continue' IDENT? | 'goto' IDENT | 'fallthrough' | 'go' Expr | 'defer' Expr | Block | If | Switch | Select | For | &label ONLY IDENT ':' Labelled | Simple ;
Labelled: Stmt | &always ;
If: 'if' Head Block ('else' (If | Block))? ;
Head: Simple~ (';' Simple~?)? | ';' Simple~? ;
Switch: 'switch' Head? '{' (('case' Exprs | 'default') ':' Stmts)* '}' ;
Select: 'select' '{' (('case' Simple | 'default') ':' Stmts)* '}' ;
For: 'for' ForHead? Block ;
ForHead: 'range' Expr~ | Ranged~ (';' Simple~? ';' Simple~?)? | ';' Simple~? ';' Simple~? ;
Ranged~: Exprs~ (ASSIGN Exprs~ | '=' Range~ | &names ':=' Range~ | '++' | '--')? ;
Range~: 'range' Expr~ | Exprs~ ;
Simple~: Exprs~ (ASSIGN Exprs~ | '=' Exprs~ | &names ':=' Exprs~ | '++' | '--')? ;
Exprs~: Expr~ (',' Expr~)* ;
Expr~: Unary~ (Bin Unary~)* ;
Bin: BINOP | '*' | '<-' | '|' | '+' | '&' | '^' | '-' ;
Unary~: ('+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~') Unary~ | Operand~ ;
Operand~: (NUMBER | STRING | CHAR) Suffix~* | IDENT Suffix~* | '(' Expr ')' Suffix~* | 'func' Signature Block? Suffix~* | '[' ('...' | Expr)? ']' Type Braced~ | 'map' '[' Type ']' Type Braced~ | Struct Braced~ | Interface Braced~ | 'chan' '<-'? Type Braced~ ;
Braced~: Literal Suffix~* | '(' Args ')' Suffix~* | &always ;
Suffix~: '.' (IDENT | '(' (Type | 'type') ')') | '[' Index ']' | '(' Args ')' | &brace &literal Literal ;
Index: ':' Expr? (':' Expr)? | Expr (':' Expr? (':' Expr)? | (',' Expr)* ','?) ;
Args: (Expr (',' Expr)* '...'? ','?)? ;
Literal: '{' (Element (',' Element)* ','?)? '}' ;
Element: Item (':' Item)? ;
Item: Expr | Literal ;
"""

RUST = r"""
File: Inner* Item* EOF ;
Inner: '#' '!' &group ;
Outer: '#' &group ;
Item: Outer* Vis? Plain CUT ;
Vis: 'pub' (&vis ONLY '(' ('crate' | 'self' | 'super' | 'in' Path) ')')? ;
Plain: 'use' UseTree ';' | 'mod' IDENT (';' | '{' Inner* Item* '}') | 'extern' 'crate' (IDENT | 'self') ('as' IDENT)? ';' | 'struct' Struct | 'enum' IDENT Generics? Where? '{' (Variant (',' Variant)* ','?)? '}' | 'union' IDENT Generics? Where? Fields | 'type' IDENT Generics? (':' Bounds)? Where? ('=' Type)? Where? ';' | 'static' 'mut'? IDENT ':' Type ('=' Expr)? ';' | 'const' 'mut'? (IDENT | '_') ':' Type ('=' Expr)? ';' | Fn | Quals Trait | Quals Impl | Extern | MacroItem | 'macro_rules' '!' IDENT Delims ;
Quals: ('unsafe' | 'default' | 'auto')* ;
Delims: &groupitem ;
MacroItem: Path '!' IDENT? Delims ;
UseTree: '*' | '{' (UseTree (',' UseTree)* ','?)? '}' | '::' ('*' | '{' (UseTree (',' UseTree)* ','?)? '}' | UsePath) | UsePath ;
UsePath: Segment ('::' ('*' | '{' (UseTree (',' UseTree)* ','?)? '}' | UsePath) | 'as' (IDENT | '_'))? ;
Segment: IDENT | 'self' | 'super' | 'crate' | 'Self' ;
Struct: IDENT Generics? (Where? Fields | Where? ';' | '(' (TupleField (',' TupleField)* ','?)? ')' Where? ';') ;
Fields: '{' (FieldDecl (',' FieldDecl)* ','?)? '}' ;
FieldDecl: Outer* Vis? IDENT ':' Type ;
TupleField: Outer* Vis? Type ;
Variant: Outer* Vis? IDENT (Fields | '(' (TupleField (',' TupleField)* ','?)? ')')? ('=' Expr)? ;
Generics: '<' (Generic (',' Generic)* ','?)? '>' ;
Generic: Outer* (LIFETIME (':' Lifetimes)? | 'const' IDENT ':' Type ('=' GenericValue)? | IDENT (':' Bounds)? ('=' Type)?) ;
GenericValue: '{' Stmts '}' | '-'? Literal | IDENT ;
Lifetimes: (LIFETIME ('+' LIFETIME)* '+'?)? ;
Bounds: (Bound ('+' Bound)* '+'?)? ;
Bound: LIFETIME | '?'? ForLives? TypePath | '(' '?'? ForLives? TypePath ')' ;
ForLives: 'for' Generics ;
Where: 'where' (WherePred (',' WherePred)* ','?)? ;
WherePred: LIFETIME ':' Lifetimes | ForLives? Type ':' Bounds ;
FnQuals: ('const' | 'async' | 'unsafe' | 'extern' STRING? | 'default')* ;
Fn: FnQuals 'fn' IDENT Generics? '(' FnParams ')' ('->' Type)? Where? (Body | ';') ;
FnParams: (FnParam (',' FnParam)* ','?)? ;
FnParam: Outer* (('&' LIFETIME?)? 'mut'? 'self' (':' Type)? | '...' | Pattern ':' ('...' | Type) | Type) ;
Trait: 'trait' IDENT Generics? (':' Bounds)? Where? '{' Inner* Assoc* '}' ;
Impl: 'impl' Generics? 'const'? '!'? Type ('for' Type)? Where? '{' Inner* Assoc* '}' ;
Assoc: Outer* Vis? 'default'? (Fn | 'const' (IDENT | '_') ':' Type ('=' Expr)? ';' | 'type' IDENT Generics? (':' Bounds)? Where? ('=' Type)? Where? ';' | Path '!' Delims) CUT ;
Extern: 'unsafe'? 'extern' STRING? '{' Inner* Item* '}' ;
Path: '::'? Segment ('::' Segment)* ;
TypePath: '::'? TypeSeg ('::' TypeSeg)* | Qualified ;
Qualified: '<' Type ('as' TypePath)? '>' ('::' TypeSeg)+ ;
TypeSeg: Segment ('::'? GenericArgs | '(' (Type (',' Type)* ','?)? ')' ('->' TypeNoPlus)?)? ;
GenericArgs: '<' (GenericArg (',' GenericArg)* ','?)? '>' ;
GenericArg: LIFETIME | '{' Stmts '}' | '-'? Literal | IDENT GenericArgs? ('=' Type | ':' Bounds) | Type ;
Type: TypeNoPlus ('+' Bounds)? ;
TypeNoPlus: '!' | '_' | '(' (Type (',' Type)* ','?)? ')' | '[' Type (';' Expr)? ']' | '&' '&'? LIFETIME? 'mut'? TypeNoPlus | '*' ('const' | 'mut') TypeNoPlus | ForLives? FnQuals 'fn' '(' FnParams ')' ('->' TypeNoPlus)? | 'impl' Bound | 'dyn' Bound | ForLives TypePath | TypePath ('!' Group)? ;
Group: &group ;
Pattern: '|'? Pat ('|' Pat)* ;
Pat: 'ref' 'mut'? IDENT ('@' Pat)? | 'mut' IDENT ('@' Pat)? | &binding ONLY IDENT ('@' Pat)? | PatRange | '_' | '..' | '&' '&'? 'mut'? Pat | '(' (Pattern (',' Pattern)* ','?)? ')' | '[' (Pattern (',' Pattern)* ','?)? ']' | 'box' Pat | 'const' Body | ExprPath ('!' Group | '(' (Pattern (',' Pattern)* ','?)? ')' | '{' (FieldPat (',' FieldPat)* ','?)? '}' | ('..=' | '...' | '..') PatEnd?)? ;
PatRange: '-'? Literal (('..=' | '...' | '..') PatEnd?)? | '..=' PatEnd | '..' PatEnd ;
PatEnd: '-'? Literal | ExprPath ;
FieldPat: Outer* ('..' | 'ref' 'mut'? IDENT | 'mut' IDENT | &fieldshort ONLY IDENT | (IDENT | NUMBER) ':' Pattern) ;
ExprPath: '::'? ExprSeg ('::' (ExprSeg | GenericArgs))* | Qualified ;
ExprSeg: Segment ;
Literal: NUMBER | STRING | CHAR | 'true' | 'false' ;
Body: '{' Inner* Stmts '}' ;
Stmts: Stmt* ;
Stmt: ';' | Outer* StmtCore ;
StmtCore: &always ONLY 'let' Pattern (':' Type)? ('=' Expr ('else' Body)?)? ';' CUT | &item ONLY Item | &macrostmt ONLY Path '!' &group CUT | &always ONLY BlockLike StmtTail CUT | Expr End CUT ;
StmtTail: ';' | Postfix Suffix* (Bin Unary | 'as' TypeNoPlus)* End | &always ;
Postfix: '?' | '.' ('await' | NUMBER | IDENT ('::' GenericArgs)?) ;
End: ';' | &closing ;
BlockLike: Label? Loops | If | Match | ('unsafe' | 'async' 'move'? | 'const') Body ;
Label: LIFETIME ':' ;
Loops: Body | 'loop' Body | 'while' Cond Body | 'for' Pattern 'in' Expr~ Body ;
If: 'if' Cond Body ('else' (If | Body))? ;
Cond: Expr~ ;
Match: 'match' Expr~ '{' Inner* Arm* '}' ;
Arm: Outer* Pattern ('if' Expr)? '=>' (&always ONLY BlockLike ArmTail | Expr ArmEnd) CUT ;
ArmTail: ',' | Postfix Suffix* (Bin Unary | 'as' TypeNoPlus)* ArmEnd | &always ;
ArmEnd: ',' | &closing ;
Expr~: ('..=' | '..') RangeEnd~? | Chain~ (('..=' | '..') RangeEnd~?)? ;
RangeEnd~: &notblock Chain~ ;
Chain~: Unary~ (Bin Unary~ | 'as' TypeNoPlus)* ;
Bin: BINOP | '*' | '&' '&'? | '|' '|'? | '-' | '+' | '<' '<'? '='? | '>' '>'? '='? | '=' ;
Unary~: ('-' | '!' | '*') Unary~ | '&' '&'? ('raw' ('const' | 'mut') | 'mut')? Unary~ | Closure~ | 'return' Expr~? | 'break' LIFETIME? Expr~? | 'continue' LIFETIME? | 'let' Pattern '=' Unary~ | Primary~ Suffix* ;
Closure~: ('for' Generics)? 'static'? 'async'? 'move'? ('|' (ClosureParam (',' ClosureParam)* ','?)? '|') ('->' TypeNoPlus Body | Expr~) ;
ClosureParam: Outer* Pat (':' Type)? ;
Primary~: Literal | '(' (Outer* Expr (',' Expr)* ','?)? ')' | '[' (Expr (';' Expr | (',' Expr)* ','?))? ']' | BlockLike | '_' | ExprPath Literalish~ ;
Literalish~: '!' Group | &brace &structlit ONLY '{' StructFields '}' | &always ;
StructFields: (StructField (',' StructField)* ','?)? ;
StructField: Outer* ('..' Expr? | (IDENT | NUMBER) (':' Expr)?) ;
Suffix: Postfix | '(' (Expr (',' Expr)* ','?)? ')' | '[' Expr ']' ;
"""

SCRIPT = r"""
File: Item* EOF ;
Item: Statement CUT ;
Block: '{' Item* '}' ;
Statement: Block | 'var' Vars &semi | 'const' ConstRest | 'let' Vars &semi | ';' | 'if' '(' Expr ')' Statement ('else' Statement)? | 'for' 'await'? '(' ForHead ')' Statement | 'while' '(' Expr ')' Statement | 'do' Statement 'while' '(' Expr ')' &anysemi | &inloop 'continue' (&sameline Name)? &semi | &inswitch 'break' (&sameline Name)? &semi | &infunction 'return' (&sameline Expr)? &semi | 'throw' &sameline Expr &semi | 'try' Block (Catch Finally? | Finally) | 'switch' '(' Expr ')' '{' Case* '}' | 'debugger' &semi | Import | Export | 'function' '*'? Name FnRest | &asyncfn ONLY 'async' 'function' '*'? Name FnRest | Decorator* &nextclass &ts 'abstract' Class | Decorator* Class | &label ONLY Name ':' Statement | &typedecl &ts ONLY TypeDecl | &exprstart Expr &semi ;
Catch: 'catch' ('(' Binding TypeAnn? ')')? Block ;
Finally: 'finally' Block ;
ConstRest: 'enum' &ts Name EnumBody | Consts &semi ;
Consts: Const (',' Const)* ;
Const: Binding (TypeAnn ('=' Assign)? | '=' Assign) ;
Case: ('case' Expr | 'default') ':' Item* ;
Vars: Var (',' Var)* ;
Var: Binding ('!' &ts)? TypeAnn? ('=' Assign)? ;
TypeAnn: &ts ':' Type ;
ForHead: ('var' | 'let' | 'const') Binding ('of' Assign | 'in' Expr) | ('var' | 'let' | 'const') Vars ';' Expr? ';' Expr? | Member ('of' Assign | 'in' Expr) | Expr? ';' Expr? ';' Expr? ;
Import: &importdecl ONLY 'import' ImportRest &semi ;
ImportRest: STRING With? | &typeimport &ts 'type' ImportClause 'from' STRING With? | ImportClause 'from' STRING With? | &ts Name '=' Assign ;
ImportClause: Name (',' (NameSpace | NamedImports))? | NameSpace | NamedImports ;
NameSpace: '*' 'as' Name ;
NamedImports: '{' (Specifier (',' Specifier)* ','?)? '}' ;
Specifier: &typespec &ts ONLY 'type' Word ('as' Word)? | (Word | STRING) ('as' (Word | STRING))? ;
With: ('with' | 'assert') '{' ((Word | STRING) ':' STRING (',' (Word | STRING) ':' STRING)* ','?)? '}' ;
Export: Decorator* 'export' ExportRest ;
ExportRest: '*' ('as' (Word | STRING))? 'from' STRING With? &semi | &braceorstar &ts ONLY 'type' (NamedImports ('from' STRING With?)? | '*' ('as' Word)? 'from' STRING) &semi | NamedImports ('from' STRING With?)? &semi | 'default' Default | '=' &ts Expr &semi | 'as' &ts 'namespace' Name &semi | 'import' &ts 'type'? Name '=' Assign &semi | 'var' Vars &semi | 'let' Vars &semi | 'const' ConstRest | 'function' '*'? Name FnRest | &asyncfn ONLY 'async' 'function' '*'? Name FnRest | Decorator* &nextclass &ts 'abstract' Class | Decorator* Class | &ts TypeDecl ;
Default: 'function' '*'? Name? FnRest | &asyncfn ONLY 'async' 'function' '*'? Name? FnRest | Decorator* (&nextclass &ts 'abstract')? Class | &nameafter &ts ONLY 'interface' Interface | &exprnotdecl Assign &semi ;
TypeDecl: 'type' Name TypeParams? '=' Type &semi | 'interface' Interface | 'enum' Name EnumBody | 'declare' Declared | ('namespace' | 'module') (Name ('.' Name)* | STRING) (Block | &semi) | 'global' Block ;
Declared: 'var' Vars &semi | 'let' Vars &semi | 'const' ('enum' Name EnumBody | Vars &semi) | 'function' '*'? Name FnRest | 'async'? 'function' Name FnRest | 'abstract'? Class | TypeDecl ;
Interface: Name TypeParams? ('extends' Type (',' Type)*)? TypeBody ;
EnumBody: '{' (EnumMember (',' EnumMember)* ','?)? '}' ;
EnumMember: (Word | STRING | '[' Expr ']') ('=' Assign)? ;
FnRest: TypeParams? Params TypeRet? (Block | &ts &semi) ;
TypeRet: &ts ':' ReturnType ;
ReturnType: &nameafter ONLY 'asserts' (Name | 'this') ('is' Type)? | &isafter ONLY (Name | 'this') 'is' Type | Type ;
Params: '(' (Param (',' Param)* ','?)? ')' ;
Param: Decorator* Access* (&ts 'this' TypeAnn | '...'? Binding ('?' &ts)? TypeAnn? ('=' Assign)?) ;
Access: &paramafter &ts ('public' | 'private' | 'protected' | 'readonly' | 'override') ;
Decorator: '@' (Name | '(' Expr ')') DecSuffix* ;
DecSuffix: '.' (Word | PRIVATE) | Args | TypeArgs &ts Args ;
Binding: Name | Array | Object ;
Class: 'class' Name? TypeParams? ('extends' Member (TypeArgs &ts)?)? ('implements' &ts Type (',' Type)*)? '{' ClassItem* '}' ;
ClassItem: ';' | &staticblock ONLY 'static' Block CUT | Decorator* Modifier* '*'? ClassName CUT ;
Modifier: &memberafter ('static' | 'async' | 'get' | 'set' | 'accessor' | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'declare' | 'override') ;
ClassName: &indexsig &ts ONLY '[' Name ':' Type ']' TypeAnn? &semi | PropName (('?' | '!') &ts)? (TypeParams? Params TypeRet? (Block | &ts &semi) | TypeAnn? ('=' Assign)? &semi) ;
PropName: Word | STRING | NUMBER | PRIVATE | '[' Assign ']' ;
Expr: Assign (',' Assign)* ;
Assign: &arrow ONLY Arrow | &arrowmaybe &ts Arrow | 'yield' (&sameline '*'? Assign)? | Cond (&target AssignOp Assign)? ;
AssignOp: '=' | ASSIGN ;
Arrow: 'async'? (Name | TypeParams? Params TypeRet?) &sameline '=>' (Block | Assign) ;
Cond: Binary ('?' Assign ':' Assign)? ;
Binary: Unary BinTail* ;
BinTail: BinOp Unary | ('as' | 'satisfies') &ts &sameline Type ;
BinOp: BINOP | '*' | '+' | '-' | '<' | 'in' | 'instanceof' | '|' | '&' | '>' ('>' '>'?)? '='? ;
Unary: ('!' | UNOP | '+' | '-' | 'typeof' | 'void' | 'delete' | 'await' | '++' | '--') Unary | &ts '<' Type '>' Unary | Member (&sameline ('++' | '--'))? ;
Member: Primary Suffix* ;
Suffix: '.' (Word | PRIVATE) | '?.' (Word | PRIVATE | '[' Expr ']' | Args | TypeArgs &ts Args | Template) | '[' Expr ']' | Args | Template | &ts &sameline '!' | &ts TypeArgs &aftertypes ;
Args: '(' (Arg (',' Arg)* ','?)? ')' ;
Arg: '...'? Assign ;
Template: TEMPLATE | TEMPLATE_HEAD Expr (TEMPLATE_MIDDLE Expr)* TEMPLATE_TAIL ;
Primary: Name | NUMBER | STRING | REGEX | Template | 'this' | 'super' | 'null' | 'true' | 'false' | '(' Expr ')' | Array | Object | 'function' '*'? Name? FnRest | &asyncfn ONLY 'async' 'function' '*'? Name? FnRest | Decorator* Class | 'new' ('.' Word | Member) | 'import' ('(' Assign (',' Assign)? ','? ')' | '.' Word) | PRIVATE | Jsx ;
Array: '[' ','* (Arg (','+ Arg)* ','*)? ']' ;
Object: '{' (Prop (',' Prop)* ','?)? '}' ;
Prop: '...' Assign |  &shorthand ONLY Name ('=' Assign)? | &propafter ONLY ('get' | 'set' | 'async') '*'? PropName TypeParams? Params TypeRet? Block | '*' PropName Params TypeRet? Block | PropName (':' Assign | TypeParams? Params TypeRet? Block) ;
Jsx: JSX_OPEN (JSX_BRACE ('...'? Assign)? JSX_END)* JSX_CLOSE ;
Word: Name | 'await' | 'yield' | KEYWORD | 'var' | 'const' | 'if' | 'else' | 'for' | 'while' | 'do' | 'continue' | 'break' | 'return' | 'throw' | 'try' | 'catch' | 'finally' | 'switch' | 'case' | 'default' | 'debugger' | 'import' | 'export' | 'function' | 'class' | 'extends' | 'in' | 'instanceof' | 'typeof' | 'void' | 'delete' | 'new' | 'this' | 'super' | 'null' | 'true' | 'false' | 'enum' | 'with' ;
Name: IDENT | 'let' | 'async' | 'of' | 'from' | 'as' | 'satisfies' | 'type' | 'interface' | 'declare' | 'namespace' | 'module' | 'global' | 'abstract' | 'static' | 'get' | 'set' | 'accessor' | 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'implements' | 'asserts' | 'is' | 'keyof' | 'unique' | 'infer' | 'assert' | 'out' ;
TypeParams: &ts '<' TypeParam (',' TypeParam)* ','? '>' ;
TypeParam: ('const' | 'in' | &nameafter 'out')* Name ('extends' Type)? ('=' Type)? ;
TypeArgs: &ts '<' Type (',' Type)* ','? '>' ;
Type: &fntype ONLY FnType | Union ('extends' &sameline Type '?' Type ':' Type)? ;
FnType: ('abstract'? 'new')? TypeParams? Params '=>' ReturnType ;
Union: '|'? Inter ('|' Inter)* ;
Inter: '&'? TypeOp ('&' TypeOp)* ;
TypeOp: &typeafter ONLY ('keyof' | 'unique' | 'readonly' | 'infer') TypeOp | PrimType (&sameline '[' Type? ']')* ;
PrimType: Name ('.' Word)* (&sameline TypeArgs)? ('is' &sameline Type)? | 'this' ('is' &sameline Type)? | 'void' | 'null' | 'true' | 'false' | STRING | NUMBER | '-' NUMBER | TemplateType | 'typeof' ('import' '(' Type ')' | Name | 'this') ('.' (Word | PRIVATE))* (&sameline TypeArgs)? | 'import' '(' Type (',' Object)? ')' ('.' Word)* TypeArgs? | 'const' | TypeBody | '[' (Tuple (',' Tuple)* ','?)? ']' | '(' Type ')' ;
TemplateType: TEMPLATE | TEMPLATE_HEAD Type (TEMPLATE_MIDDLE Type)* TEMPLATE_TAIL ;
Tuple: '...'? (&labelled ONLY Word '?'? ':' Type | Type '?'?) ;
TypeBody: &mapped ONLY '{' Mapped '}' | '{' (TypeMember TypeSep)* '}' ;
TypeSep: ';' | ',' | &typeend ;
Mapped: (('+' | '-')? 'readonly')? '[' Name 'in' Type ('as' Type)? ']' (('+' | '-')? '?')? (':' Type)? (';' | ',')? ;
TypeMember: 'new' TypeParams? Params TypeRet? | TypeParams? Params TypeRet? | &memberafter ONLY ('get' | 'set') PropName Params TypeRet? | &memberafter ONLY 'readonly' PropMember | PropMember ;
PropMember: (&indexsig ONLY '[' Name ':' Type ']' TypeAnn? | PropName '?'? (TypeParams? Params TypeRet? | TypeAnn?)) ;
"""

PYTHON = r"""
File: NEWLINE? Statement* EOF ;
Statement: Compound CUT | Simples CUT ;
Simples: Simple (';' Simple)* ';'? NEWLINE ;
Simple: 'pass' | 'break' | 'continue' | 'return' Stars? | 'raise' (Test ('from' Test)?)? | 'global' IDENT (',' IDENT)* | 'nonlocal' IDENT (',' IDENT)* | 'del' Stars | 'assert' Test (',' Test)? | 'import' Dotted ('as' IDENT)? (',' Dotted ('as' IDENT)?)* | 'from' (Dots Dotted? | Dotted) 'import' ImportNames | 'type' IDENT TypeParams? '=' Test | Stars Assigned ;
Dots: ('.' | '...')+ ;
Dotted: IDENT ('.' IDENT)* ;
ImportNames: '*' | '(' ImportName (',' ImportName)* ','? ')' | ImportName (',' ImportName)* ;
ImportName: IDENT ('as' IDENT)? ;
Assigned: &single AUGMENTED Right | &single ':' Test ('=' Right)? | (&targets '=' Right)* ;
Right: 'yield' Yield | Stars ;
Compound: 'if' Named Suite ('elif' Named Suite)* ('else' Suite)? | 'while' Named Suite ('else' Suite)? | For | 'try' Suite (Except+ ('else' Suite)? ('finally' Suite)? | 'finally' Suite) | With | Def | Class | Decorated | 'async' (Def | With | For) | 'match' Star (',' Star)* ','? ':' NEWLINE INDENT Case+ DEDENT ;
For: 'for' Targets 'in' Stars Suite ('else' Suite)? ;
Except: 'except' '*'? (Stars ('as' IDENT)?)? Suite ;
With: 'with' ('(' WithItem (',' WithItem)* ','? ')' Suite | WithItem (',' WithItem)* Suite) ;
WithItem: Test ('as' Target)? ;
Decorated: ('@' Named NEWLINE)+ (Def | Class | 'async' Def) ;
Def: 'def' IDENT TypeParams? '(' Params ')' ('->' Stars)? Suite ;
Class: 'class' IDENT TypeParams? ('(' Args ')')? Suite ;
TypeParams: '[' TypeParam (',' TypeParam)* ','? ']' ;
TypeParam: ('*' | '**')? IDENT (':' Test)? ('=' ('*' Or | Test))? ;
Params: (Param (',' Param)* ','?)? ;
Param: IDENT (':' Test)? ('=' Test)? | '*' (IDENT (':' ('*' Or | Test))?)? | '**' IDENT (':' Test)? | '/' ;
Suite: ':' (Simples | NEWLINE INDENT Statement+ DEDENT) ;
Case: 'case' Patterns ('if' Named)? Suite ;
Patterns: Pattern (',' Pattern)* ','? ;
Pattern: '*' IDENT | OrPattern ('as' IDENT)? ;
OrPattern: Closed ('|' Closed)* ;
Closed: Number | STRINGS | 'None' | 'True' | 'False' | IDENT ('.' IDENT)* ('(' (PatArg (',' PatArg)* ','?)? ')')? | '(' Patterns? ')' | '[' Patterns? ']' | '{' (PatItem (',' PatItem)* ','?)? '}' ;
PatArg: &kwarg ONLY IDENT '=' Pattern | Pattern ;
PatItem: '**' IDENT | Closed ':' Pattern ;
Number: '-'? NUMBER (('+' | '-') NUMBER)? ;
Stars: Starred (',' Starred)* ','? | 'yield' Yield ;
Starred: '*' Or | Test ;
Star: '*' Or | Named ;
Yield: ('from' Test | Stars)? ;
Named: &walrus ONLY IDENT ':=' Test | Test ;
Test: 'lambda' LambdaParams ':' Test | Or ('if' Or 'else' Test)? ;
LambdaParams: (LambdaParam (',' LambdaParam)* ','?)? ;
LambdaParam: IDENT ('=' Test)? | '*' IDENT? | '**' IDENT | '/' ;
Or: Unary (BinOp Sign | ('and' | 'or') Unary)* ;
BinOp: BINOP | '*' | '**' | '+' | '-' | '/' | '@' | '|' | 'in' | 'not' 'in' | 'is' 'not'? ;
Unary: 'not' Unary | Sign ;
Sign: ('+' | '-' | '~') Sign | 'await' Atom Trailer* | Atom Trailer* ;
Trailer: '(' Args ')' | '[' Subscripts ']' | '.' IDENT ;
Args: (Arg (',' Arg)* ','?)? ;
Arg: '*' Test | '**' Test | &kwarg ONLY IDENT '=' Test | Named CompFor? ;
Subscripts: Subscript (',' Subscript)* ','? ;
Subscript: '*' Or | Named? ':' Test? (':' Test?)? | Named ;
Atom: IDENT | NUMBER | STRINGS | '...' | 'None' | 'True' | 'False' | '(' ('yield' Yield | '*' Or ',' (Star (',' Star)* ','?)? | Named (CompFor | (',' Star)* ','?))? ')' | '[' (Star (CompFor | (',' Star)* ','?))? ']' | '{' Braced '}' ;
Braced: (('**' Or | '*' Or | Named (':' Test)?) (CompFor | (',' ('**' Or | '*' Or | Named (':' Test)?))* ','?))? ;
CompFor: ('async'? 'for' Targets 'in' CompIn ('if' CompIf)*)+ ;
CompIn: 'lambda' LambdaParams ':' Test | Or ;
CompIf: &walrus ONLY IDENT ':=' Or | Or ;
Targets: Target (',' Target)* ','? ;
Target: '*' Target | '(' Targets? ')' Trailer* | '[' Targets? ']' Trailer* | IDENT Trailer* ;
"""
