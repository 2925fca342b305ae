"""Grammars of statements, members and list items of twelve languages, over tokens whose bracketed parts are one token.

`(x)`, `[x]` and `{x}` stand for a bracketed part whose content is an x; `i` is a name, `n` a number, `"` a string,
`name` a name or any keyword.
"""

from __future__ import annotations

_EXPR = """
Expr = Un
Expr = Un Bin Expr
Expr = Un Asg Expr
Un = Post
Un = Pre Un
Post = Prim
Post = Post . name
Post = Post (args)
Post = Post [index]
Prim = i
Prim = n
Prim = "
Prim = (expr)
Arg = Expr
Index = Expr
Cond = Expr
Bin = +
Bin = -
Bin = *
Bin = /
Bin = %
Bin = ==
Bin = !=
Bin = <
Bin = >
Bin = <=
Bin = >=
Bin = &&
Bin = ||
Bin = &
Bin = |
Bin = ^
Bin = < <
Bin = > >
Asg = =
Asg = +=
Asg = -=
Asg = *=
Asg = /=
Asg = %=
Asg = &=
Asg = |=
Asg = ^=
Pre = -
Pre = +
Pre = !
Pre = ~~
Pre = &
Pre = *
"""

_TERNARY = """
Expr = Un ? Expr : Expr
"""

_INC = """
Post = Post ++
Post = Post --
Pre = ++
Pre = --
"""

_FLOW = """
Stmt = ;
Stmt = {block}
Stmt = if (cond) Stmt
Stmt = if (cond) Stmt else Stmt
Stmt = while (cond) Stmt
Stmt = for (for) Stmt
"""

_JS = (
    _EXPR
    + _TERNARY
    + _INC
    + _FLOW
    + """
Post = Post ?. name
Post = Post ?. (args)
Post = Post ?. [index]
Post = Post "
Prim = this
Prim = super
Prim = null
Prim = true
Prim = false
Prim = undefined
Prim = [list]
Prim = {object}
Prim = new Post
Prim = new . name
Prim = Func
Prim = class i~ Heritage~ {members}
Prim = import (args)
Prim = @ i
Func = async~ function *~ i~ Generic~ (params) Ret~ {block}
Expr = Arrow
Arrow = async~ (params) Ret~ => Body
Arrow = async~ i => Body
Body = {block}
Body = Expr
Bin = ===
Bin = !==
Bin = ??
Bin = in
Bin = instanceof
Bin = **
Bin = > > >
Asg = ??=
Asg = ||=
Asg = &&=
Asg = **=
Pre = typeof
Pre = void
Pre = delete
Pre = await
Expr = yield *~ Expr~
Arg = ... Expr
Comma = Expr
Comma = Expr , Comma
Cond = Comma
Index = Comma
Prop = ... Expr
Prop = Key : Expr
Prop = i
Prop = i = Expr
Prop = Mod~ Key (params) Ret~ {block}
Key = name
Key = "
Key = n
Key = [index]
Mod = async *~
Mod = get
Mod = set
Mod = *
Stmt = Comma ;~
Stmt = return Comma~ ;~
Stmt = throw Expr ;~
Stmt = break i~ ;~
Stmt = continue i~ ;~
Stmt = debugger ;~
Stmt = Var Binds ;~
Stmt = do Stmt while (cond) ;~
Stmt = for await (for) Stmt
Stmt = try {block} Catch
Catch = catch (params)~ {block}
Catch = finally {block}
Catch = catch (params)~ {block} finally {block}
Stmt = switch (cond) {cases}
Stmt = i : Stmt
Stmt = Decl
Var = const
Var = let
Var = var
Binds = Bind
Binds = Bind , Binds
Bind = Target = Expr
Bind = Target
Target = i
Target = {names}
Target = [names]
Name = Target
Name = Target = Expr
Name = Key : Target
Name = Key : Target = Expr
Name = ... Target
Param = Target
Param = Target = Expr
Param = ... Target
For = Var Binds ; Comma~ ; Comma~
For = Comma~ ; Comma~ ; Comma~
For = Var Target of Expr
For = Var Target in Expr
For = Post of Expr
For = Post in Expr
Decl = async~ function *~ i Generic~ (params) Ret~ {block}
Decl = Deco~ abstract~ class i Generic~ Heritage~ {members}
Deco = @ i
Deco = @ i (args)
Deco = Deco Deco
Heritage = extends Expr
Stmt = import Import from " ;~
Stmt = import " ;~
Import = i
Import = {specs}
Import = * as i
Import = i , {specs}
Import = i , * as i
Spec = name
Spec = name as name
Stmt = export Decl
Stmt = export Var Binds ;~
Stmt = export default Expr ;~
Stmt = export default Decl
Stmt = export {specs} ;~
Stmt = export {specs} from " ;~
Stmt = export * from " ;~
Stmt = export * as i from " ;~
Case = Stmt
Case = case Comma : Case~
Case = default : Case~
Member = ;
Member = Access~ Mod~ Key Generic~ (params) Ret~ {block}
Member = Access~ Key = Expr ;~
Member = Access~ Key ;~
Member = Deco Member
Member = static {block}
Access = static
"""
)

_TYPES = """
Stmt = Decl ;
Decl = interface i Generic~ Extends~ {fields}
Stmt = type i Generic~ = Type ;~
Stmt = export type i Generic~ = Type ;~
Stmt = import type Import from " ;~
Stmt = export type {specs} from " ;~
Stmt = export type {specs} ;~
Import = type i
Spec = type name
Stmt = declare Stmt
Decl = const~ enum i {enum}
Decl = namespace i {block}
Decl = declare Decl
Enum = name
Enum = name = Expr
Extends = extends Types
Heritage = extends Expr implements Types
Heritage = implements Types
Heritage = extends i TypeArgs
Heritage = extends i TypeArgs implements Types
Types = Type
Types = Type , Types
Generic = < Types >
Ret = : Type
Ret = : i is Type
Type = Union
Type = TypePre Type
Type = keyof Type
Union = Inter
Union = | Union
Union = Inter | Union
Union = Inter & Union
Inter = Postfix
Inter = (params) => Type
Inter = new (params) => Type
Inter = typeof Post
Inter = Postfix extends Postfix ? Type : Type
Type = i extends Type
Type = i = Type
Postfix = TypeAtom
Postfix = Postfix [empty]
Postfix = Postfix [types]
TypePre = readonly
TypeAtom = Dotted
TypeAtom = Dotted TypeArgs
TypeAtom = {fields}
TypeAtom = [types]
TypeAtom = (types)
TypeAtom = "
TypeAtom = n
TypeAtom = null
TypeAtom = void
TypeAtom = undefined
TypeAtom = this
TypeAtom = true
TypeAtom = false
Dotted = i
Dotted = Dotted . name
TypeArgs = < Types >
TypeItem = Type
TypeItem = i : Type
TypeItem = i ? : Type
Bind = Target Ann = Expr
Bind = Target ! Ann
Bind = Target Ann
Ann = : Type
Param = Acc Param
Param = Target ? Ann~
Param = Target Ann
Param = Target Ann = Expr
Param = this Ann
Param = ... Target Ann
Param = Deco Param
Acc = public
Acc = private
Acc = protected
Acc = readonly
Access = Acc
Access = abstract
Access = override
Access = declare
Access = Access Access
Member = Access~ Key Opt~ Ann = Expr ;~
Member = Access~ Key Opt~ Ann ;~
Member = Access~ Mod~ Key Opt~ Generic~ (params) Ret~ ;~
Opt = ?
Opt = !
Field = readonly~ Key ?~ Ann ;~
Field = readonly~ [names] Ann ;~
Field = Key ?~ Generic~ (params) Ret~ ;~
Field = (params) Ret ;~
Field = [key] Ann ;~
KeyAnn = i Ann
Post = Post !
Post = Post TypeArgs (args)
Prim = new Dotted TypeArgs (args)
Un = Un as Type
Un = Un as const
Un = Un satisfies Type
Arrow = async~ Generic (params) Ret~ => Body
"""

_JAVA_TYPES = """
Type = Dotted TypeArgs~ Dims~
Type = Prim0 Dims~
Type = Note Type
Dims = [empty]
Dims = Dims [empty]
Dotted = i
Dotted = Dotted . i
Dotted = Dotted TypeArgs . i
TypeArgs = < >
TypeArgs = < Types >
Types = TypeArg
Types = TypeArg , Types
TypeArg = Type
TypeArg = ?
TypeArg = ? extends Type
TypeArg = ? super Type
"""

_JAVA = (
    _EXPR
    + _TERNARY
    + _INC
    + _FLOW
    + _JAVA_TYPES
    + """
Bin = > > >
Un = Post instanceof Type i~
Prim = this
Prim = super
Prim = null
Prim = true
Prim = false
Prim = new Type (args) {members}~
Prim = new Type {list}
Prim = new Dotted [index] Dims~
Prim = new Prim0 [index] Dims~
Prim = Prim0 . class
Prim = Prim0 Dims . class
Prim = switch (cond) {cases}
Post = Post :: name
Post = Post :: new
Post = Post . TypeArgs i (args)
Pre = (type)
CastType = Type
Expr = (params) -> Body
Expr = i -> Body
Body = {block}
Body = Expr
Item = Expr
Item = {list}
ArrayEmpty = [empty]
Stmt = Expr ;
Stmt = return Expr~ ;
Stmt = throw Expr ;
Stmt = break i~ ;
Stmt = continue i~ ;
Stmt = yield Expr ;
Stmt = assert Expr ;
Stmt = assert Expr : Expr ;
Stmt = Local ;
Local = final~ Type Decls
Decls = DeclOne
Decls = DeclOne , Decls
DeclOne = i Dims~
DeclOne = i Dims~ = Init
Init = Expr
Init = {list}
Stmt = do Stmt while (cond) ;
Stmt = try (resources)~ {block} Catches~
Catches = catch (params) {block}
Catches = catch (params) {block} Catches
Catches = finally {block}
Res = Local
Res = Local ; Res
Stmt = switch (cond) {cases}
Stmt = synchronized (cond) {block}
Stmt = i : Stmt
Stmt = TypeDecl
For = Local~ ; Expr~ ; Exprs~
For = Exprs ; Expr~ ; Exprs~
For = final~ Type i : Expr
Exprs = Expr
Exprs = Expr , Exprs
Param = final~ Type ...~ i Dims~
Param = final~ Types0 i
Param = i
Param = Note Param
Types0 = Type | Type
Types0 = Type | Types0
Case = Stmt
Case = case Exprs : Case~
Case = default : Case~
Case = case Exprs -> Arm
Case = default -> Arm
Arm = Stmt
Note = @ Dotted
Note = @ Dotted (args)
Top = package Dotted ;
Top = import static~ Dotted ;
Top = import static~ Dotted . * ;
Top = TypeDecl
Top = ;
TypeDecl = Mods~ class i Generic~ Ext~ Impl~ Perm~ {members}
TypeDecl = Mods~ interface i Generic~ ExtI~ Perm~ {members}
TypeDecl = Mods~ @ interface i {members}
TypeDecl = Mods~ enum i Impl~ {enum}
TypeDecl = Mods~ record i Generic~ (params) Impl~ {members}
Ext = extends Type
ExtI = extends Types
Impl = implements Types
Perm = permits Types
Generic = < TypeParams >
TypeParams = TypeParam
TypeParams = TypeParam , TypeParams
TypeParam = i
TypeParam = i extends Bound
Bound = Type
Bound = Type & Bound
Mods = Mod
Mods = Mod Mods
Mod = Note
Mod = public
Mod = private
Mod = protected
Mod = static
Mod = final
Mod = abstract
Mod = native
Mod = synchronized
Mod = transient
Mod = volatile
Mod = strictfp
Mod = default
Mod = sealed
Member = ;
Member = static~ {block}
Member = TypeDecl
Member = Mods~ Type Decls ;
Member = Mods~ Generic~ Type i (params) Dims~ Throws~ {block}
Member = Mods~ Generic~ Type i (params) Dims~ Throws~ ;
Member = Mods~ Type i (empty) default Expr ;
Member = Mods~ Generic~ i (params) Throws~ {block}
Throws = throws Types
Enum = Note~ i (args)~ {members}~
EnumTail = Enums ; Members~
Arg = Expr
Arg = i = Expr
Arg = {list}
"""
)

_CS = (
    _EXPR
    + _TERNARY
    + _INC
    + _FLOW
    + """
Type = Dotted TypeArgs~ ?~ Dims~
Type = Prim0 ?~ Dims~
Type = (types) ?~
Dims = [empty]
Dims = Dims [empty]
Dotted = i
Dotted = Dotted . i
Dotted = Dotted TypeArgs . i
TypeArgs = < Types >
Types = Type
Types = Type , Types
TypeItem = Type
TypeItem = Type i
Bin = ??
Asg = ??=
Post = Post ?. name
Post = Post ? [index]
Post = Post !
Post = Post TypeArgs (args)
Un = Un is Type i~
Un = Un is not~ null
Un = Un as Type
Prim = this
Prim = base
Prim = null
Prim = true
Prim = false
Prim = Prim0
Prim = new Type (args) {object}~
Prim = new Type~ {object}
Prim = new (args)
Prim = new Type [index] {list}~
Prim = new [empty] {list}
Prim = typeof (type)
Prim = nameof (args)
Prim = default (type)~
Prim = [list]
Un = Un switch {arms}
Arm = Expr => Expr
Pre = (type)
Pre = await
CastType = Type
Expr = async~ (params) => Body
Expr = async~ i => Body
Expr = throw Expr
Body = {block}
Body = Expr
Item = Expr
Item = {list}
Item = Expr => Expr
Prop = i = Expr
Prop = [index] = Expr
Prop = Expr
Prop = {list}
Arg = i : Expr
Arg = ref Expr
Arg = out Expr
Arg = out Type i
Arg = in Expr
Stmt = Expr ;
Stmt = return Expr~ ;
Stmt = throw Expr~ ;
Stmt = break ;
Stmt = continue ;
Stmt = yield return Expr ;
Stmt = yield break ;
Stmt = await~ using Local ;
Stmt = Local ;
Local = const~ Type Decls
Decls = DeclOne
Decls = DeclOne , Decls
DeclOne = i
DeclOne = i = Init
Init = Expr
Init = {list}
Stmt = do Stmt while (cond) ;
Stmt = await~ foreach (each) Stmt
Each = Type i in Expr
Stmt = try {block} Catches
Catches = Catch
Catches = Catch Catches
Catch = catch {block}
Catch = catch (params) {block}
Catch = catch (params) when (cond) {block}
Catch = catch (type) {block}
Catch = finally {block}
Stmt = switch (cond) {cases}
Stmt = lock (cond) Stmt
Stmt = await~ using (using) Stmt
Using = Local
Using = Expr
Stmt = i : Stmt
Stmt = Mods~ Type i Generic~ (params) {block}
For = Local~ ; Expr~ ; Exprs~
For = Exprs ; Expr~ ; Exprs~
Exprs = Expr
Exprs = Expr , Exprs
Param = Attr~ ParamMod~ Type i~
Param = Attr~ ParamMod~ Type i = Expr
Param = i
ParamMod = ref
ParamMod = out
ParamMod = in
ParamMod = this
ParamMod = params
Case = Stmt
Case = case Expr : Case~
Case = case Type i : Case~
Case = case Expr when Expr : Case~
Case = default : Case~
Attr = [attr]
Attr = Attr [attr]
AttrItem = Dotted
AttrItem = Dotted (args)
AttrItem = i : Dotted (args)~
Top = using static~ Dotted ;
Top = using i = Type ;
Top = global using static~ Dotted ;
Top = namespace Dotted ;
Top = namespace Dotted {members}
Top = TypeDecl
Top = Attr
TypeDecl = Attr~ Mods~ Kind i Generic~ (params)~ Inherit~ Wheres~ {members}
TypeDecl = Attr~ Mods~ record i Generic~ (params) Inherit~ ;
TypeDecl = Attr~ Mods~ enum i Inherit~ {enum}
TypeDecl = Attr~ Mods~ delegate Type i Generic~ (params) ;
Kind = class
Kind = struct
Kind = interface
Kind = record
Kind = record struct
Kind = record class
Inherit = : Types
Wheres = where i : Constraints
Constraints = Constraint
Constraints = Constraint , Constraints
Constraint = Type
Constraint = class
Constraint = struct
Constraint = new (args)
Generic = < GenericNames >
GenericNames = i
GenericNames = i , GenericNames
Mods = Mod
Mods = Mod Mods
Mod = public
Mod = private
Mod = protected
Mod = internal
Mod = static
Mod = readonly
Mod = sealed
Mod = abstract
Mod = virtual
Mod = override
Mod = async
Mod = const
Mod = partial
Mod = extern
Mod = unsafe
Mod = volatile
Mod = new
Member = ;
Member = TypeDecl
Member = Top
Member = Attr~ Mods~ event~ Type Decls ;
Member = Attr~ Mods~ Type i Generic~ (params) Wheres~ {block}
Member = Attr~ Mods~ Type i Generic~ (params) Wheres~ ;
Member = Attr~ Mods~ Type i Generic~ (params) => Expr ;
Member = Attr~ Mods~ i (params) CtorInit~ {block}
Member = Attr~ Mods~ Type i {accessors}
Member = Attr~ Mods~ Type i {accessors} = Expr ;
Member = Attr~ Mods~ Type i => Expr ;
Member = Attr~ Mods~ Type this [params] {accessors}
CtorInit = : base (args)
CtorInit = : this (args)
Accessor = Attr~ Mods~ AccKind ;
Accessor = Attr~ Mods~ AccKind {block}
Accessor = Attr~ Mods~ AccKind => Expr ;
AccKind = get
AccKind = set
AccKind = init
AccKind = add
AccKind = remove
Enum = Attr~ i
Enum = Attr~ i = Expr
"""
)

_CPP = (
    _EXPR
    + _TERNARY
    + _INC
    + _FLOW
    + """
Type = Quals~ Base Quals~ Ptr~
Quals = Qual
Quals = Qual Quals
Qual = const
Qual = volatile
Qual = static
Qual = constexpr
Qual = inline
Qual = extern
Qual = mutable
Qual = virtual
Qual = explicit
Qual = friend
Qual = thread_local
Qual = register
Qual = typename
Qual = [attr]
Base = Scoped
Base = Prim0s
Base = auto
Base = decltype (args)
Base = struct Scoped
Base = enum Scoped
Base = class Scoped
Prim0s = Prim0
Prim0s = Prim0 Prim0s
Scoped = i
Scoped = :: i
Scoped = i TArgs
Scoped = Scoped :: i
Scoped = Scoped :: i TArgs
Scoped = Scoped :: ~~ i
TArgs = < >
TArgs = < TList >
TList = TItem
TList = TItem , TList
TItem = Type
TItem = n
TItem = "
TItem = Type (params)
TItem = Type ...
Ptr = *
Ptr = &
Ptr = &&
Ptr = * const
Ptr = Ptr Ptr
Post = Post -> name
Post = Post -> ~~ i
Post = Post {list}
Prim = Scoped
Prim = this
Prim = nullptr
Prim = true
Prim = false
Prim = Prim0 (args)
Prim = Prim0 {list}
Prim = " Strings
Strings = "
Strings = " Strings
Prim = new Type
Prim = new Type (args)
Prim = new Type [index]
Prim = new Type {list}
Prim = sizeof (args)
Prim = i TArgs (type) (args)
Prim = [capture] (params)~ mutable~ Arrow0~ {block}
Prim = [index] (params)~ mutable~ Arrow0~ {block}
Prim = [empty] (params)~ mutable~ Arrow0~ {block}
Prim = co_await Expr
Capt = =
Capt = &
Capt = & i
Capt = i
Capt = this
Capt = i = Expr
Arrow0 = -> Type
Pre = (type)
Pre = delete
Pre = delete [empty]
Pre = sizeof
CastType = Type
Arg = Type
Arg = {list}
Arg = Expr ...
Item = Expr
Item = {list}
Item = . i = Expr
Stmt = Expr ;
Stmt = Expr , Expr ;
Stmt = return Expr~ ;
Stmt = return {list} ;
Stmt = throw Expr~ ;
Stmt = break ;
Stmt = continue ;
Stmt = goto i ;
Stmt = i : Stmt
Stmt = Local ;
Stmt = using namespace Scoped ;
Stmt = using Scoped ;
Stmt = using i = Type ;
Stmt = typedef Type i ;
Stmt = static_assert (args) ;
Stmt = TypeDecl
Stmt = if constexpr (cond) Stmt
Stmt = if constexpr (cond) Stmt else Stmt
Stmt = do Stmt while (cond) ;
Stmt = try {block} Catches
Catches = catch (params) {block}
Catches = catch (params) {block} Catches
Stmt = switch (cond) {cases}
Stmt = co_return Expr~ ;
Cond = Local
Cond = Local ; Expr
Local = Type Decls
Decls = DeclOne
Decls = DeclOne , Decls
DeclOne = Ptr~ i Arr~
DeclOne = Ptr~ i Arr~ = Init
DeclOne = Ptr~ i (args)
DeclOne = Ptr~ i Arr~ {list}
DeclOne = [names] = Init
DeclOne = & [names] = Init
Name = i
Arr = [empty]
Arr = [index]
Arr = Arr Arr
Init = Expr
Init = {list}
For = Local~ ; Expr~ ; Exprs~
For = Exprs ; Expr~ ; Exprs~
For = Type i : Init
For = Type [names] : Init
Exprs = Expr
Exprs = Expr , Exprs
Param = Type
Param = Type ...~ i Arr~
Param = Type ...~ i Arr~ = Init
Param = ...
Param = Type = Init
Case = Stmt
Case = case Expr : Case~
Case = default : Case~
Top = Member
Top = namespace Scoped~ {tops}
Top = inline namespace Scoped {tops}
Top = extern " {tops}
Top = extern " Member
Top = Stmt
Template = template < TParams~ >
TParams = TParam
TParams = TParam , TParams
TParam = typename ...~ i~
TParam = class ...~ i~
TParam = typename i = Type
TParam = Type i~
TParam = Type i = Expr
TypeDecl = Kind Attr~ Scoped final~ Bases~ {members} Decls~ ;
TypeDecl = Kind Scoped ;
TypeDecl = Kind {members} Decls~ ;
TypeDecl = enum class~ i Under~ {enum} ;
TypeDecl = enum class~ i Under~ ;
TypeDecl = enum {enum} ;
TypeDecl = typedef Kind i~ {members} i ;
Under = : Type
Kind = class
Kind = struct
Kind = union
Bases = : BaseList
BaseList = BaseOne
BaseList = BaseOne , BaseList
BaseOne = Access~ virtual~ Scoped
Access = public
Access = private
Access = protected
Enum = i
Enum = i = Expr
Member = ;
Member = Access : Member~
Member = TypeDecl
Member = Stmt
Member = Template Member
Member = Type Ptr~ Fn Tail~ {block}
Member = Type Ptr~ Fn Tail~ ;
Member = Type Ptr~ Fn Tail~ = Special ;
Member = Quals~ Scoped (params) Tail~ Inits~ {block}
Member = Quals~ Scoped (params) Tail~ ;
Member = Quals~ Scoped (params) Tail~ = Special ;
Member = Quals~ ~~ i (params) Tail~ {block}
Member = Quals~ ~~ i (params) Tail~ ;
Member = Quals~ ~~ i (params) Tail~ = Special ;
Special = default
Special = delete
Special = n
Fn = Scoped (params)
Fn = operator Op (params)
Fn = Scoped :: operator Op (params)
Fn = operator (empty) (params)
Fn = operator [empty] (params)
Op = Bin
Op = Asg
Op = ++
Op = --
Op = !
Op = ->
Tail = const
Tail = noexcept
Tail = override
Tail = final
Tail = -> Type
Tail = Tail Tail
Inits = : InitList
InitList = InitOne
InitList = InitOne , InitList
InitOne = Scoped (args)
InitOne = Scoped {list}
"""
)

_RUST = (
    _EXPR
    + """
Type = Path
Type = & Life~ mut~ Type
Type = && Life~ mut~ Type
Type = [type]
Type = [array]
Type = (types)
Type = !
Type = _
Type = dyn Bounds
Type = impl Bounds
Type = * const Type
Type = * mut Type
Type = unsafe~ Ext~ fn (types) Ret~
Ext = extern "~
Life = L
ArrType = Type ; Expr
Bounds = Bound
Bounds = Bound + Bounds
Bound = Path
Bound = L
Bound = ? Path
Bound = Fnb
Fnb = Path (types) Ret~
Path = PSeg
Path = :: PSeg
Path = Path :: PSeg
Path = Path :: GArgs
PSeg = i
PSeg = i GArgs
PSeg = self
PSeg = Self
PSeg = crate
PSeg = super
Path = < Type as Path > :: PSeg
GArgs = < GList >
GList = GItem
GList = GItem , GList
GItem = Type
GItem = L
GItem = n
GItem = i = Type
Ret = -> Type
TypeItem = Type
TypeItem = i : Type
Prim = Path
Prim = true
Prim = false
Prim = [list]
Prim = [repeat]
Repeat = Expr ; Expr
Prim = (args)
Prim = {block}
Prim = unsafe {block}
Prim = async move~ {block}
Prim = Path {fields}
Prim = Macro
Macro = Path ! (any)
Macro = Path ! [any]
Macro = Path ! {any}
Prim = Flow
Flow = if Cnd {block}
Flow = if Cnd {block} else {block}
Flow = if Cnd {block} else Flow
Flow = match Expr {arms}
Flow = Lab~ loop {block}
Flow = Lab~ while Cnd {block}
Flow = Lab~ for Pat in Expr {block}
Lab = L :
Cnd = Expr
Cnd = let Pat = Expr
Cnd = Cnd && Cnd
Prim = return Expr~
Prim = break L~ Expr~
Prim = continue L~
Prim = move~ | Pats~ | Ret~ Expr
Prim = move~ || Ret~ Expr
Pats = Pat
Pats = Pat : Type
Pats = Pats , Pats
Post = Post ?
Post = Post . await
Post = Post . n
Un = Un as Type
Pre = & mut
Pre = &&
Pre = & & mut~
Bin = ..
Bin = ..=
Expr = .. Expr
Expr = Un ..
Expr = ..
Asg = < < =
Asg = > > =
FieldInit = name : Expr
FieldInit = i
FieldInit = .. Expr
FieldInit = Attr FieldInit
Pat = PatOne
Pat = |~ PatOne | Pat
PatOne = Path
PatOne = ref~ mut~ i
PatOne = mut i
PatOne = i @ PatOne
PatOne = Lit
PatOne = Lit ..= Lit
PatOne = Lit .. Lit~
PatOne = _
PatOne = ..
PatOne = & mut~ PatOne
PatOne = (pats)
PatOne = [pats]
PatOne = Path (pats)
PatOne = Path {fieldpats}
Lit = -~ n
Lit = "
Lit = true
Lit = false
FieldPat = ref~ mut~ i
FieldPat = i : Pat
FieldPat = ..
Arm = Attr~ Pat Guard~ => Expr
Guard = if Cnd
Stmt = ;
Stmt = Expr ;
Stmt = Flow
Stmt = {block}
Stmt = unsafe {block}
Stmt = Macro
Stmt = let Pat Ann~ ;
Stmt = let Pat Ann~ = Expr ;
Stmt = let Pat Ann~ = Expr else {block} ;
Stmt = Attr Stmt
Stmt = Top
Last = Expr
Ann = : Type
Attr = # !~ [any]
Attr = Attr Attr
Top = Attr Top
Top = # ! [any]
Top = Vis~ use UseTree ;
Top = Vis~ mod i ;
Top = Vis~ mod i {tops}
Top = extern crate i ;
Top = Vis~ const i Ann = Expr ;
Top = Vis~ const _ Ann = Expr ;
Top = Vis~ static mut~ i Ann = Expr ;
Top = Vis~ type i Generic~ = Type ;
Top = Vis~ struct i Generic~ Where~ {fielddefs}
Top = Vis~ struct i Generic~ (tuplefields) ;
Top = Vis~ struct i Generic~ ;
Top = Vis~ enum i Generic~ Where~ {variants}
Top = Vis~ union i Generic~ {fielddefs}
Top = Vis~ unsafe~ trait i Generic~ Super~ Where~ {tops}
Top = unsafe~ impl Generic~ Type Where~ {tops}
Top = unsafe~ impl Generic~ !~ Type for Type Where~ {tops}
Top = Vis~ FnMods~ fn i Generic~ (params) Ret~ Where~ {block}
Top = Vis~ FnMods~ fn i Generic~ (params) Ret~ Where~ ;
Top = unsafe~ extern "~ {tops}
Top = type i Super~ ;
Top = i ! i~ {any}
Top = Macro ;~
FnMods = FnMod
FnMods = FnMod FnMods
FnMod = const
FnMod = async
FnMod = unsafe
FnMod = extern "~
Super = : Bounds
Where = where WhereList
WhereList = WhereOne
WhereList = WhereOne , WhereList~
WhereOne = Type : Bounds
WhereOne = L : Bounds
Generic = < GParams~ >
GParams = GParam
GParams = GParam , GParams
GParam = i Super~
GParam = i = Type
GParam = L
GParam = L : Bounds
GParam = const i : Type
Vis = pub
Vis = pub (any)
UseTree = UPath
UseTree = UPath :: *
UseTree = UPath :: {uses}
UseTree = UPath as i
UseTree = {uses}
UseTree = *
UPath = i
UPath = crate
UPath = self
UPath = super
UPath = :: i
UPath = UPath :: i
UPath = UPath :: super
UPath = UPath :: crate
Use = UseTree
Param = Attr~ Pat : Type
Param = &~ Life~ mut~ self
Param = self : Type
Param = ...
FieldDef = Attr~ Vis~ name : Type
TupleField = Attr~ Vis~ Type
Variant = Attr~ i
Variant = Attr~ i (tuplefields)
Variant = Attr~ i {fielddefs}
Variant = Attr~ i = Expr
"""
)

_ZIG = (
    _EXPR
    + """
Type = ! Type
Expr = TypeX
TypeX = * const~ Expr
TypeX = ? Expr
TypeX = [empty] const~ Expr
TypeX = [size] const~ Expr
TypeX = ! Expr
Type = Expr
Type = Post ! Expr
Un = Post ! Un
Prim = . i
Prim = . {fields}
Prim = . {list}
Prim = . {empty}
Post = Post {fields}
Post = Post {list}
Post = Post {empty}
Prim = true
Prim = false
Prim = null
Prim = undefined
Prim = anytype
Prim = unreachable
Prim = @ i (args)
Prim = error . i
Prim = error {names}
Post = Post . *
Post = Post . ?
Prim = Agg
Agg = packed~ struct {members}
Agg = extern struct {members}
Agg = enum (args)~ {members}
Agg = union (args)~ {members}
Agg = opaque {members}
Prim = fn (params) Type
Bin = or
Bin = and
Bin = orelse
Bin = ++
Bin = **
Bin = + %
Bin = - %
Bin = * %
Un = Un catch Cap~ Expr
Cap = | Caps |
Caps = CapOne
Caps = CapOne , Caps
CapOne = *~ i
Pre = try
Pre = comptime
Pre = await
Pre = - %
Expr = return Expr~
Expr = break Lab0~ Expr~
Expr = continue Lab0~
Lab0 = : i
Expr = if (cond) Cap~ Expr
Expr = if (cond) Cap~ Expr else Cap~ Expr
Expr = switch (cond) {arms}
Expr = Blk
Expr = Loop
Blk = {block}
Blk = i : {block}
Loop = Lab1~ inline~ while (cond) Cap~ Step~ Blk
Loop = Lab1~ inline~ while (cond) Cap~ Step~ Blk else Cap~ Blk
Loop = Lab1~ inline~ for (args) Cap~ Blk
Loop = Lab1~ inline~ for (args) Cap~ Blk else Blk
Lab1 = i :
Step = : (cond)
Arg = Expr ..
Arg = Expr .. Expr
Index = Expr ..
Index = Expr .. Expr
Index = Expr .. Expr~ : Expr
Size = *
Size = Expr
Size = : Expr
Size = * : Expr
Size = _
Size = Expr : Expr
Arm = Prongs => Cap~ ArmBody
Arm = else => Cap~ ArmBody
ArmBody = Expr
Prongs = Prong
Prongs = Prong , Prongs
Prong = Expr
Prong = Expr ... Expr
Item = Expr
FieldInit = . i = Expr
Name = i
Stmt = Expr ;
Stmt = Expr Asg Expr ;
Stmt = _ = Expr ;
Stmt = comptime~ VarDecl
Stmt = comptime {block}
Stmt = Blk
Stmt = Loop
Stmt = inline~ If
Stmt = defer Stmt
Stmt = errdefer Cap~ Stmt
Stmt = switch (cond) {arms}
If = if (cond) Cap~ Stmt
If = if (cond) Cap~ Stmt else Cap~ Stmt
If = if (cond) Cap~ Expr else Cap~ Stmt
Stmt = while (cond) Cap~ Step~ Stmt
Stmt = for (args) Cap~ Stmt
VarDecl = Vis~ Kw i Ann~ Align~ = Expr ;
VarDecl = Vis~ Kw i Ann ;
Align = align (args)
Ann = : Type
Kw = const
Kw = var
Vis = pub
Vis = export
Vis = extern "~
Vis = pub extern "~
Vis = pub export
Vis = threadlocal
Vis = pub inline
Vis = inline
Top = VarDecl
Top = Vis~ fn i (params) Conv~ Type {block}
Top = Vis~ fn i (params) Conv~ Type ;
Conv = callconv (args)
Conv = align (args)
Top = test "~ {block}
Top = test i {block}
Top = comptime {block}
Top = pub~ usingnamespace Expr ;
Member = Top
Member = comptime~ i Ann Align~
Member = comptime~ i Ann = Expr
Member = i
Member = i = Expr
Param = Mod0~ i : Type
Param = Mod0~ _ : Type
Param = Type
Param = ...
Mod0 = comptime
Mod0 = noalias
"""
)

_GO = (
    _EXPR
    + """
Type = Dotted TypeArgs~
Type = * Type
Type = [empty] Type
Type = [index] Type
Type = [dots] Type
Type = map [types] Type
Type = chan Type
Type = < - chan Type
Type = chan < - Type
Type = func (params) Result~
Type = interface {methods}
Type = struct {fields}
Type = (type)
CastType = Type
TypeArgs = [types]
TypeItem = Type
Dotted = i
Dotted = i . i
Result = Type
Result = (params)
Bin = & ^
Bin = < -
Pre = ^
Pre = < -
Post = Post . (type)
Post = Post . (typekw)
TypeKw = type
Post = Post {list}
Post = Post {empty}
Prim = Lit {list}
Prim = Lit {empty}
Lit = [empty] Type
Lit = [index] Type
Lit = [dots] Type
Lit = map [types] Type
Lit = struct {fields}
Prim = [empty] Type (args)
Prim = func (params) Result~ {block}
Prim = interface {methods}
Prim = nil
Prim = true
Prim = false
Index = Expr~ : Expr~
Index = Expr : Expr : Expr
Arg = Expr ...
Arg = Type
Item = Expr
Item = Elem : Elem
Item = {list}
Elem = Expr
Elem = {list}
Exprs = Expr
Exprs = Expr , Exprs
Simple = Expr
Simple = Exprs := Exprs
Simple = Exprs = Exprs
Simple = Un Asg Expr
Simple = Un ++
Simple = Un --
Simple = Expr < - Expr
Asg = < < =
Asg = > > =
Stmt = Simple
Stmt = return Exprs~
Stmt = break i~
Stmt = continue i~
Stmt = goto i
Stmt = fallthrough
Stmt = go Expr
Stmt = defer Expr
Stmt = Block
Stmt = If
Stmt = for {block}
Stmt = for Expr {block}
Stmt = for Simple~ ; Expr~ ; Simple~ {block}
Stmt = for Exprs := range Expr {block}
Stmt = for Exprs = range Expr {block}
Stmt = for range Expr {block}
Stmt = switch Head~ {cases}
Stmt = select {cases}
Stmt = i :
Stmt = i : Stmt
Stmt = Decl
Head = Simple
Head = Simple ; Simple~
Block = {block}
If = if Simple {block}
If = if Simple ; Expr {block}
If = if Simple {block} else {block}
If = if Simple ; Expr {block} else {block}
If = if Simple {block} else If
If = if Simple ; Expr {block} else If
Case = Stmt
Case = case Exprs : Case~
Case = case Simple : Case~
Case = case Types : Case~
Case = default : Case~
Types = Type
Types = Type , Types
Decl = var Spec
Decl = const Spec
Decl = var (specs)
Decl = const (specs)
Decl = type i TParams~ =~ Type
Decl = type (typespecs)
Spec = Names Type
Spec = Names Type~ = Exprs
Spec = Names
TypeSpec = i =~ Type
Names = i
Names = i , Names
TParams = [params]
Top = package i
Top = import "
Top = import i "
Top = import . "
Top = import (imports)
Import = "
Import = i "
Import = . "
Top = Decl
Top = func (params)~ i TParams~ (params) Result~ {block}
Top = func i (params) Result~
Param = Type
Param = i ...~ Type
Param = ... Type
Field = Names Type "~
Field = *~ Dotted "~
Method = i (params) Result~
Method = Dotted
Method = Union
Union = Type
Union = ~~ Type
Union = Union | Union
"""
)

_KT = (
    _EXPR
    + _INC
    + """
Type = TypeOne ?~
Type = (types) -> Type
Type = suspend Type
Type = TypeOne . (types) -> Type
TypeOne = i TypeArgs~
TypeOne = TypeOne . i TypeArgs~
TypeOne = (type)
CastType = Type
TypeArgs = < TList >
TList = TItem
TList = TItem , TList
TItem = Type
TItem = *
TItem = in Type
TItem = out Type
TypeItem = Type
TypeItem = i : Type
Bin = ===
Bin = !==
Bin = ?:
Bin = ..
Bin = ..<
Bin = in
Bin = ! in
Bin = i
Un = Un as ?~ Type
Un = Un is Type
Un = Un ! is Type
Post = Post ?. name
Post = Post !!
Post = Post :: name
Post = Post :: class
Post = Post TypeArgs (args)
Post = Post (args) {lambda}
Post = Post {lambda}
Prim = :: i
Prim = this
Prim = super
Prim = null
Prim = true
Prim = false
Prim = {lambda}
Prim = object {members}
Prim = object : Supers {members}
Prim = fun (params) Ret~ FBody
Prim = return Expr~
Prim = return @ i Expr~
Prim = throw Expr
Prim = break
Prim = continue
Prim = if (cond) Branch
Prim = if (cond) Branch ;~ else Branch
Prim = when (when)~ {arms}
Prim = try {block} Catches
Prim = @ i
Branch = {block}
Branch = Expr
Catches = catch (params) {block}
Catches = catch (params) {block} Catches
Catches = finally {block}
When = Expr
When = val i = Expr
Arm = Conds -> Branch
Arm = else -> Branch
Conds = CondOne
Conds = CondOne , Conds
CondOne = Expr
CondOne = !~ in Expr
CondOne = !~ is Type
Arg = i = Expr
Arg = * Expr
Lambda = Stmt
Lambda = LNames -> Stmt~
LNames = LName
LNames = LName , LNames
LName = i
LName = i : Type
LName = (names)
Name = i
Name = i : Type
Name = _
Stmt = Expr
Stmt = while (cond) Branch
Stmt = do {block} while (cond)
Stmt = for (for) Branch
For = i in Expr
For = i : Type in Expr
For = (names) in Expr
Stmt = Note~ Decl
Stmt = i @ Stmt
Decl = Mods~ Vk Generic~ Vn Getter~
Decl = Mods~ Vk Generic~ Vn = Expr Getter~
Decl = Mods~ Vk Vn by Expr
Vk = val
Vk = var
Vn = i
Vn = i : Type
Vn = TypeOne . i : Type
Vn = (names)
Getter = get (params) FBody
Getter = get (params) Ret FBody
Decl = Mods~ fun Generic~ FName (params) Ret~ FBody~
FName = i
FName = TypeOne . i
FBody = {block}
FBody = = Expr
Ret = : Type
Decl = Mods~ Kind i Generic~ Ctor~ SupersC~ {members}~
Decl = Mods~ object i~ SupersC~ {members}~
Decl = Mods~ enum class i Ctor~ SupersC~ {enum}~
Decl = Mods~ typealias i Generic~ = Type
Decl = init {block}
Decl = Mods~ constructor (params) CtorCall~ {block}~
CtorCall = : this (args)
CtorCall = : super (args)
Ctor = (params)
Ctor = Mods constructor (params)
Kind = class
Kind = interface
Kind = fun interface
SupersC = : Supers
Supers = Super
Supers = Super , Supers
Super = Type
Super = Type (args)
Super = Type by Expr
Generic = < GList >
GList = GOne
GList = GOne , GList
GOne = Var0~ i
GOne = Var0~ i : Type
Var0 = in
Var0 = out
Var0 = reified
Mods = Mod
Mods = Mod Mods
Mod = public
Mod = private
Mod = protected
Mod = internal
Mod = open
Mod = abstract
Mod = final
Mod = override
Mod = const
Mod = lateinit
Mod = data
Mod = sealed
Mod = inline
Mod = suspend
Mod = operator
Mod = infix
Mod = companion
Mod = tailrec
Mod = value
Mod = annotation
Mod = inner
Mod = external
Mod = vararg
Mod = Note
Note = @ Dotted (args)~
Note = @ i : Dotted (args)~
Dotted = i
Dotted = Dotted . i
Param = Mods~ Vk~ i : Type
Param = Mods~ Vk~ i : Type = Expr
Param = i
Enum = Note~ i (args)~ {members}~
Member = Stmt
Top = package Dotted
Top = import Dotted
Top = import Dotted . *
Top = import Dotted as i
Top = Note~ Decl
Top = Note
Index = Expr
"""
)

_SWIFT = (
    _EXPR
    + _TERNARY
    + """
Type = TypeOne
Type = Type ?
Type = Type !
Type = (types) throws~ -> Type
Type = @ i Type
Type = inout Type
Type = some Type
Type = any Type
Type = Type & Type
Type = (types) async throws~ -> Type
TypeOne = i TypeArgs~
TypeOne = TypeOne . name TypeArgs~
TypeOne = [type]
TypeOne = [pair]
TypeOne = (types)
CastType = Type
PairType = Type : Type
TypeArgs = < TList >
TList = Type
TList = Type , TList
TypeItem = Type
TypeItem = i~ i : Type
Bin = ===
Bin = !==
Bin = ??
Bin = ...
Bin = ..<
Bin = &+
Un = Un as Type
Un = Un as ? Type
Un = Un as ! Type
Un = Un is Type
Post = Post ?. name
Post = Post ? . name
Post = Post !
Post = Post ?
Post = Post (args) {lambda}
Post = Post {lambda}
Post = Post TypeArgs (args)
Prim = . name
Prim = # i
Prim = # i (args)
Prim = self
Prim = super
Prim = nil
Prim = true
Prim = false
Prim = [list]
Prim = [pairs]
Prim = [type] (args)
Prim = [pair] (args)
Prim = {lambda}
Prim = (args)
Prim = \\ . name
Prim = if Conds {block} else Els
Prim = switch Expr {cases}
Item = Expr
Pair = Expr : Expr
Arg = name : Expr
Arg = name : & Expr
Pre = try
Pre = try ?
Pre = try !
Pre = await
Pre = &
Lambda = Stmt
Lambda = LHead in Stmt~
LHead = Names
LHead = (params) Throw~ Arrow0~
LHead = [list] Names~
Names = i
Names = i , Names
Arrow0 = -> Type
Conds = CondOne
Conds = CondOne , Conds
CondOne = Expr
CondOne = Vk Pat Ann~ = Expr
CondOne = Vk i
CondOne = case Pat = Expr
CondOne = # available (args)
Pat = i
Pat = _
Pat = (names)
Pat = Vk Pat
Pat = . name (args)~
Pat = Pat as Type
Pat = is Type
Pat = Expr
Name = i
Name = _
Name = Vk i
Stmt = Expr
Stmt = return Expr~
Stmt = throw Expr
Stmt = break i~
Stmt = continue i~
Stmt = fallthrough
Stmt = if Conds {block}
Stmt = if Conds {block} else Els
Els = {block}
Els = if Conds {block}
Els = if Conds {block} else Els
Stmt = guard Conds else {block}
Stmt = while Conds {block}
Stmt = repeat {block} while Expr
Stmt = for Pat in Expr {block}
Stmt = for Pat in Expr where Expr {block}
Stmt = switch Expr {cases}
Stmt = do {block} Catches~
Catches = catch Pat~ {block}
Catches = catch Pat~ {block} Catches
Stmt = defer {block}
Stmt = Decl
Case = Stmt
Case = @~ i~ case Pats : Case~
Case = default : Case~
Pats = PatW
Pats = PatW , Pats
PatW = Pat
PatW = Pat where Expr
Vk = let
Vk = var
Ann = : Type
Attrs = Attr
Attrs = Attr Attrs
Attr = @ i (args)~
Attr = Mod
Mod = public
Mod = private
Mod = fileprivate
Mod = internal
Mod = open
Mod = static
Mod = final
Mod = override
Mod = class
Mod = mutating
Mod = lazy
Mod = weak
Mod = unowned
Mod = required
Mod = convenience
Mod = indirect
Mod = dynamic
Mod = nonisolated
Mod = private (args)
Decl = Attrs~ Vk Binds
Binds = Bind
Binds = Bind , Binds
Bind = Pat1 Ann~
Bind = Pat1 Ann~ = Expr
Bind = i Ann~ {accessors}
Bind = i Ann~ = Expr {accessors}
Pat1 = i
Pat1 = (names)
Pat1 = _
Accessor = get Throw~ {block}~
Accessor = mutating~ set (params)~ {block}~
Accessor = willSet (params)~ {block}
Accessor = didSet (params)~ {block}
Accessor = Stmt
Decl = Attrs~ func FName Generic~ (params) Throw~ Arrow0~ Where~ {block}~
FName = i
FName = Bin
Throw = async~ throws
Throw = rethrows
Throw = async
Decl = Attrs~ init Opt~ Generic~ (params) Throw~ {block}~
Opt = ?
Opt = !
Decl = deinit {block}
Decl = Attrs~ subscript (params) Arrow0 {accessors}
Decl = Attrs~ Kind Dotted Generic~ Inherit~ Where~ {members}
Decl = Attrs~ typealias i Generic~ = Type
Decl = associatedtype i Inherit~
Decl = Attrs~ enum i Generic~ Inherit~ {members}
Decl = Attrs~ case ECases
ECases = ECase
ECases = ECase , ECases
ECase = name (types)~
ECase = name = Expr
Kind = class
Kind = struct
Kind = protocol
Kind = extension
Kind = actor
Dotted = i
Dotted = Dotted . i
Inherit = : TList
Where = where WList
WList = WOne
WList = WOne , WList
WOne = TypeOne == Type
WOne = TypeOne : Type
Generic = < GList >
GList = GOne
GList = GOne , GList
GOne = i
GOne = i : Type
Param = Attrs~ name~ name : Type
Param = Attrs~ name~ name : Type ...
Param = Attrs~ name~ name : Type = Expr
Param = i
Member = Decl
Member = Attrs
Top = import Dotted
Top = @ i import Dotted
Top = import Kind Dotted
Top = Stmt
"""
)

_PY = (
    _EXPR
    + """
Expr = Un if Expr else Expr
Expr = lambda Params~ : Expr
Expr = i := Expr
Expr = not Expr
Expr = await Expr
Bin = //
Bin = **
Bin = @
Bin = and
Bin = or
Bin = in
Bin = not in
Bin = is
Bin = is not
Prim = True
Prim = False
Prim = None
Prim = ...
Prim = [list]
Prim = [comp]
Prim = {dict}
Prim = {set}
Prim = {comp}
Prim = (comp)
Prim = (tuple)
Prim = (empty)
Prim = " Strings
Strings = "
Strings = " Strings
Comp = Expr CompFor
Comp = Expr : Expr CompFor
CompFor = async~ for Targets in Expr
CompFor = async~ for Targets in Expr if Expr
CompFor = CompFor CompFor
CompFor = CompFor if Expr
Pair = Expr : Expr
Pair = ** Expr
Item = Expr
Item = * Expr
Item = yield Expr~
Arg = * Expr
Arg = ** Expr
Arg = i = Expr
Arg = Expr CompFor
Index = Expr~ : Expr~
Index = Expr~ : Expr~ : Expr~
Index = Expr
Index = * Expr
Params = Param
Params = Param , Params
Param = i
Param = i : Expr
Param = i = Expr
Param = i : Expr = Expr
Param = * i~
Param = * i : Expr
Param = ** i
Param = ** i : Expr
Param = /
Exprs = Item
Exprs = Item ,
Exprs = Item , Exprs
Targets = Target
Targets = Target ,
Targets = Target , Targets
Target = *~ Post
Asg = //=
Asg = **=
Asg = @=
Asg = > > =
Asg = < < =
Simple = Exprs
Simple = Assign
Assign = Exprs = Exprs
Assign = Exprs = Assign
Simple = Post Asg Exprs
Simple = Post : Expr
Simple = Post : Expr = Exprs
Simple = return Exprs~
Simple = raise Expr~
Simple = raise Expr from Expr
Simple = pass
Simple = break
Simple = continue
Simple = yield Exprs~
Simple = yield from Expr
Simple = del Exprs
Simple = assert Exprs
Simple = global Names
Simple = nonlocal Names
Names = i
Names = i , Names
Simple = import Mods
Mods = ModAs
Mods = ModAs , Mods
ModAs = Dotted
ModAs = Dotted as i
Dotted = i
Dotted = Dotted . i
Simple = from From import *
Simple = from From import Specs
Simple = from From import (specs)
From = Dotted
From = Dots
From = Dots Dotted
Dots = .
Dots = ...
Dots = Dots Dots
Specs = Spec
Specs = Spec , Specs
Spec = i
Spec = i as i
Simple = type i = Expr
Line = Simple
Line = Simple ;
Line = Simple ; Line
Line = @ Expr
Head = def i (params) Ret~ :
Head = async def i (params) Ret~ :
Ret = -> Expr
Head = class i (args)~ :
Head = if Expr :
Head = while Expr :
Head = async~ for Targets in Exprs :
Head = async~ with Withs :
Head = async~ with (withs) :
Head = try :
Head = match Exprs :
Head = case Exprs :
Mid = elif Expr :
Mid = else :
Mid = except :
Mid = except Expr :
Mid = except * Expr :
Mid = except Expr as i :
Mid = finally :
Withs = WithOne
Withs = WithOne , Withs
WithOne = Expr
WithOne = Expr as Post
One = Head Line
One = Mid Line
"""
)

_RB = (
    _EXPR
    + _TERNARY
    + """
Expr = not Expr
Expr = Un and Expr
Expr = Un or Expr
Bin = **
Bin = <=>
Bin = ===
Bin = =~
Bin = !~
Bin = ..
Bin = ...
Asg = ||=
Asg = &&=
Asg = **=
Asg = < < =
Prim = : name
Prim = : "
Prim = @ i
Prim = @ @ i
Prim = $ i
Prim = nil
Prim = true
Prim = false
Prim = self
Prim = super
Prim = yield
Prim = [list]
Prim = {hash}
Prim = -> (params)~ {lambda}
Prim = " Strings
Strings = "
Strings = " Strings
Prim = :: i
Prim = defined ? Expr
Post = Post &. name
Post = Post . (args)
Post = Post :: i
Post = Post {lambda}
Post = Post ?
Post = Post !
Post = Post (args) {lambda}
Cmd = Post CArgs
CArgs = CArg
CArgs = CArg , CArgs
CArg = Arg
Arg = i : Expr~
Arg = " : Expr
Arg = Expr => Expr
Arg = * Expr
Arg = ** Expr
Arg = & Expr
Arg = & : name
Item = Expr
Item = * Expr
Pair = name : Expr~
Pair = " : Expr
Pair = Expr => Expr
Pair = ** Expr
Lambda = Simple
Lambda = | Params~ | Simple~
Params = Param
Params = Param , Params
Param = i
Param = i = Expr
Param = i : Expr~
Param = * i~
Param = ** i~
Param = & i
Param = (params)
Exprs = Item
Exprs = Item , Exprs
Simple = Expr
Simple = Cmd
Simple = Lhs = Exprs
Simple = Lhs = Cmd
Simple = Un Asg Cmd
Simple = return Exprs~
Simple = break Expr~
Simple = next Expr~
Simple = redo
Simple = retry
Simple = raise Exprs~
Simple = yield CArgs
Simple = super CArgs
Simple = alias name name
Simple = undef name
Lhs = LhsOne
Lhs = LhsOne , Lhs
LhsOne = *~ Post
Line = Simple
Line = Simple Modif
Line = Simple ;
Line = Simple ; Line
Modif = if Expr
Modif = unless Expr
Modif = while Expr
Modif = until Expr
Modif = rescue Expr
Line = Def end
Open = Def
Def = def FName (params)~
Def = def FName Params
Def = def FName ;
FName = name
FName = name ?
FName = name !
FName = name =
FName = self . name
FName = self . name ?
FName = Bin
FName = [empty]
Open = private~ Def
Open = if Expr
Open = unless Expr
Open = while Expr do~
Open = until Expr do~
Open = for Lhs in Expr do~
Open = case Expr~
Open = class CName
Open = class CName < Expr
Open = class < < self
Open = module CName
CName = i
CName = CName :: i
Open = begin
Open = Line0 do
Open = Line0 do | Params |
Line0 = Simple
Open = Lhs = Rhs
Open = Lhs Asg Rhs
Open = return Rhs
Rhs = if Expr
Rhs = case Expr~
Rhs = begin
Rhs = unless Expr
Mid = else
Mid = else Line
Mid = elsif Expr then~
Mid = when Exprs
Mid = when Exprs then Line
Mid = in Expr
Mid = rescue
Mid = rescue Exprs
Mid = rescue Exprs~ => i
Mid = ensure
Close = end
Close = end . i (args)~
Close = end {lambda}
Close = end ;
Line = begin Line0 end
Line = if Expr then Line end
"""
)

GRAMMARS = {"js": _JS, "ts": _JS + _TYPES, "java": _JAVA, "cs": _CS, "cpp": _CPP, "rs": _RUST, "zig": _ZIG, "go": _GO, "kt": _KT, "swift": _SWIFT, "py": _PY, "rb": _RB}
