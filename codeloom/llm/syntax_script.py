"""Syntax check of JavaScript and TypeScript, with or without JSX: grammars and token stream for the derivative parser.

The token stream asks the parser where the language is ambiguous: a slash opens a regular expression, and an angle bracket a
JSX element, where the grammar can go on that way; a semicolon is inserted where a token cannot stand and the language inserts
one there.
"""

from __future__ import annotations

import re
from functools import cache

from .derivatives import Grammar

# Rules of all four dialects. Names that a dialect doesn't define stand for the empty language.
RULES = """
file = item*
item = statement | import | export
semi = ';' | 'AUTO'
block = '{' statement* '}'
statement = block | ';' | variables semi | expressionS semi | 'if' '(' expression ')' statement ('else' statement)? | for
 | 'while' '(' expression ')' statement | 'do' statement 'while' '(' expression ')' semi? | switch | ('break' | 'continue') ID? semi
 | 'return' expression? semi | 'with' '(' expression ')' statement | ID ':' statement | 'throw' expression semi | try | 'debugger' semi
 | function | class | ts_statement
for = 'for' 'await'? '(' for_head ')' statement
for_head = (for_variables | expression)? ';' expression? ';' expression? | (('var' | 'let' | 'const') target annotation? | operand) ('of' assign | 'in' expression)
for_variables = ('var' | 'let' | 'const') binding (',' binding)*
variables = ('var' | 'let') binding (',' binding)* | 'const' constant (',' constant)*
binding = ID definite? annotation? ('=' assign)? | pattern annotation? '=' assign
constant = target annotation? '=' assign | ts_constant
target = ID | pattern
pattern = '[' ','* (element (','+ element)* ','*)? ']' | '{' (property_target (',' property_target)* ','?)? '}'
element = '...'? target ('=' assign)?
property_target = '...' target | ID ('=' assign)? | key ':' target ('=' assign)?
switch = 'switch' '(' expression ')' '{' (('case' expression | 'default') ':' statement*)* '}'
try = 'try' block ('catch' ('(' target annotation? ')')? block ('finally' block)? | 'finally' block)
function = decorators? 'async'? 'function' '*'? ID? signature (block | overload)
signature = type_params? '(' params? ')' returns?
params = param (',' param)* ','?
param = decorators? modifiers? '...'? (target | 'this') optional? annotation? ('=' assign)?
class = decorators? abstract? 'class' ID? type_params? ('extends' heritage)? implements? '{' member* '}'
heritage = operand
member = ';' | decorators? modifiers? member_body | 'static' block
member_body = ('async' | 'get' | 'set' | 'static' | 'accessor')* '*'? key (optional | definite)? (signature (block | overload) | annotation? ('=' assign)? semi) | index_signature semi
key = WORD | STR | NUM | PRIVATE | '[' assign ']'
decorators = ('@' decorator)+
decorator = ID ('.' (WORD | PRIVATE))* type_args? arguments? | '(' expression ')'
import = 'import' (STR | clause 'from' STR) attributes? semi | ts_import
clause = ID (',' (named_imports | '*' 'as' ID))? | named_imports | '*' 'as' ID
named_imports = '{' (import_name (',' import_name)* ','?)? '}'
import_name = type_only? (WORD | STR) ('as' ID)?
attributes = ('with' | 'assert') object
export = 'export' ('*' ('as' (WORD | STR))? 'from' STR attributes? semi | named_exports ('from' STR attributes?)? semi | 'default' (function | class | assignS semi | ts_default)
 | variables semi | function | class | ts_statement | ts_export) | decorators 'export' 'default'? class
named_exports = '{' (export_name (',' export_name)* ','?)? '}'
export_name = type_only? (WORD | STR) ('as' (WORD | STR))?
expression = assign (',' assign)*
expressionS = assignS (',' assign)*
assign = unary prefix* primary suffix* 'POST'? tail | 'new'* primary suffix* placed | yield
assignS = unary prefix* primary suffix* 'POST'? tail | 'new'+ primary suffix* placed | primaryS suffix* placed | yield
assignN = unary prefix* primary suffix* 'POST'? tail | 'new'+ primary suffix* placed | primaryN suffix* placed | yield
placed = ASSIGN assign | 'POST'? tail
yield = 'yield' '*'? assign?
tail = (BINARY operand | casts)* ('?' assign ':' assign)?
operand = prefix* primary suffix* ('POST')?
prefix = unary | 'new'
unary = 'delete' | 'void' | 'typeof' | '+' | '-' | '~' | '!' | 'await' | '++' | '--' | assertion
suffix = '.' (WORD | PRIVATE) | '?.' (WORD | PRIVATE | '[' expression ']' | type_args? arguments | template) | '[' expression ']' | arguments | template | ts_suffix
arguments = '(' (argument (',' argument)* ','?)? ')'
argument = '...'? assign
primary = primaryN | object
primaryN = primaryS | function_expression | class
primaryS = ID ('=>' body)? | 'this' | 'super' | 'null' | 'true' | 'false' | NUM | STR | REGEX | PRIVATE 'in' operand | template | array | paren
 | 'async' ID '=>' body | 'async' type_params? '(' cover? ')' returns? '=>' body | 'async' 'function' '*'? ID? signature block
 | 'new' '.' 'target' | 'import' '.' 'meta' | 'import' '(' argument (',' argument)* ','? ')' | jsx | type_params '(' cover? ')' returns? '=>' body
function_expression = 'function' '*'? ID? signature block
paren = '(' cover ')' (returns? '=>' body)? | '(' ')' returns? '=>' body
cover = covered (',' covered)* ','?
covered = '...' target annotation? ('=' assign)? | assign | typed_param
body = block | assignN
template = 'TEMPLATE' | 'HEAD' expression ('MIDDLE' expression)* 'TAIL'
array = '[' ','* (argument (','+ argument)* ','*)? ']'
object = '{' (property (',' property)* ','?)? '}'
property = '...' assign | ID ('=' assign)? | key ':' assign | ('async' | 'get' | 'set')? '*'? key signature block
"""

TYPES = """
annotation = ':' type
definite = '!'
optional = '?'
overload = semi
returns = ':' type
abstract = 'abstract'
modifiers = ('public' | 'private' | 'protected' | 'readonly' | 'override' | 'abstract' | 'declare' | 'static' | 'accessor' | 'in' | 'out')+
implements = 'implements' type (',' type)*
type_only = 'type'
ts_constant = target annotation
typed_param = target '?'? annotation? ('=' assign)? | 'this' annotation
assertion = '<' type '>'
casts = ('as' | 'satisfies') ('const' | type)
ts_suffix = '!' | type_args
ts_statement = 'declare' declared | interface | alias | enum | namespace | 'declare' 'global' block_items
declared = ('var' | 'let' | 'const') ambient (',' ambient)* semi | 'async'? 'function' '*'? ID signature semi | class | interface | alias | enum | namespace
ambient = target annotation? ('=' assign)?
interface = 'interface' ID type_params? ('extends' type (',' type)*)? '{' type_members '}'
alias = 'type' ID type_params? '=' type semi
enum = 'const'? 'enum' ID '{' (enum_member (',' enum_member)* ','?)? '}'
enum_member = (WORD | STR | '[' STR ']') ('=' assign)?
namespace = ('namespace' | 'module') (ID ('.' ID)* | STR) (block_items | semi)
block_items = '{' item* '}'
ts_import = 'import' 'type' clause 'from' STR attributes? semi | 'import' 'type'? ID '=' (ID ('.' WORD)* | 'require' '(' STR ')') semi
ts_export = 'type' (named_exports ('from' STR attributes?)? | '*' ('as' WORD)? 'from' STR attributes?) semi | '=' assign semi | 'as' 'namespace' ID semi | ts_import
ts_default = interface | abstract class
type_params = '<' type_param (',' type_param)* ','? '>'
type_param = ('const' | 'in' | 'out')* ID ('extends' type)? ('=' type)?
type_args = '<' type (',' type)* ','? '>'
type = union ('extends' union '?' type ':' type)? | ID 'is' type | 'this' 'is' type | 'asserts' (ID | 'this') ('is' type)?
union = ('|' | '&')? single (('|' | '&') single)*
single = ('keyof' | 'unique' | 'readonly' | 'infer')* base ('[' type? ']')*
base = ID ('.' WORD)* type_args? | 'void' | 'null' | 'this' | 'true' | 'false' | STR | NUM | '-' NUM | template | 'typeof' (ID | 'this' | 'import' '(' type ')') ('.' (WORD | PRIVATE))* type_args?
 | '(' type ')' | function_type | 'abstract'? 'new' function_type | '{' type_members '}' | '[' (tuple_item (',' tuple_item)* ','?)? ']' | 'import' '(' type (',' object)? ')' ('.' WORD)* type_args?
function_type = type_params? '(' params? ')' '=>' type
tuple_item = '...'? (WORD '?'? ':')? type '?'?
type_members = (type_member separator)* type_member?
separator = ';' | ',' | 'AUTO'
type_member = (('readonly' | 'get' | 'set')* key '?'? (signature | annotation?)) | signature | 'new' signature | index_signature | mapped
index_signature = ('readonly' | 'static')* '[' ID ':' type ']' annotation
mapped = (('+' | '-')? 'readonly')? '[' ID 'in' type ('as' type)? ']' (('+' | '-')? '?')? annotation?
"""

ELEMENTS = """
jsx = 'J<' (JNAME attribute* ('J/>' | 'J>' child* 'J</' JNAME 'J>') | 'J>' child* 'J</' 'J>')
attribute = JNAME ('=' (STR | '{' assign '}' | jsx))? | '{' '...' assign '}'
child = 'JTEXT' | jsx | '{' ('...'? expression)? '}'
"""

# fixed values: reserved words, words that are reserved only in places, and operators
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof "
    "new null return super switch this throw true try typeof var void while with".split()
)
CONTEXTUAL = frozenset(
    "abstract accessor as assert asserts async await declare from get global implements infer interface is keyof let meta module namespace of out "
    "override private protected public readonly require satisfies set static target type unique yield".split()
)
BINARY = frozenset("+ - * / % ** < > <= >= == != === !== && || ?? & | ^ << >> >>> in instanceof".split())
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())

_TOKEN = re.compile(
    r"""(?P<space>(?:[ \t\r\n\v\f\u00a0\ufeff\u2028\u2029\u2003]|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)*+)(?:
    (?P<word>[^\W\d][\w$\u200c\u200d]*+|\$[\w$]*+|\\u[0-9a-fA-F]{4}[\w$]*+)
   |(?P<op>[(){}\[\],;:~@]|\.\.\.|\.(?!\d)|=>|===|!==|==|!=|=|>>>=|>>=|<<=|\*\*=|&&=|\|\|=|\?\?=|[-+*%&|^]=|<=|>=|>>>|>>|<<|\*\*|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|[-+*%&|^<>!?])
   |(?P<string>"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*+"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*+')
   |(?P<number>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*+|0[bB][01](?:_?[01])*+|0[oO][0-7](?:_?[0-7])*+|(?:(?:[0-9](?:_?[0-9])*+)?\.[0-9](?:_?[0-9])*+|[0-9](?:_?[0-9])*+\.?)(?:[eE][+-]?[0-9](?:_?[0-9])*+)?)n?)
   |(?P<template>`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(?:`|\$\{))
   |(?P<slash>/=?)
   |(?P<private>\#[^\W\d][\w$]*+|\#\$[\w$]*+)
   |(?P<end>\Z)
    )""",
    re.VERBOSE,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*+\])++/[a-zA-Z]*+")
_TEMPLATE_GO_ON = re.compile(r"\}(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(?:`|\$\{)")
_TAG = re.compile(r"\s*+(?:(?P<name>[^\W\d][\w$.:-]*+)|(?P<string>\"[^\"]*+\"|'[^']*+')|(?P<op>/\s*>|[>={<])|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)")
_CLOSE = re.compile(r"</\s*([\w$.:-]*)\s*>")
_OPENS_ELEMENT = re.compile(r"<\s*(?:>|[^\W\d])")
_OPENS_TYPE_PARAMS = re.compile(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|=(?!=)|extends\b(?!\s*[=/>]))")
_TEXT = re.compile(r"[^<{}>]*+")
_RESTRICTED = frozenset(("return", "break", "continue", "throw"))


def _outside_functions(rules: str) -> str:
    """Rules by which statements outside of functions hold no return; TypeScript's parser leaves that to its checker."""
    names = ("statement", "block", "for", "switch", "try")
    outer = []
    for name in names:
        rule = re.search(rf"(?m)^{name} = .*(?:\n \|.*)*", rules)[0].replace("'return' expression? semi | ", "")
        outer.append(re.sub(rf"(?<!')\b({'|'.join(names)})\b(?!')", r"\1_outside", rule))
    return rules.replace("item = statement |", "item = statement_outside |") + "\n".join(outer) + "\n"


@cache
def grammar(types: bool, elements: bool) -> Grammar:
    rules = (RULES if types else _outside_functions(RULES)) + (TYPES if types else "") + (ELEMENTS if elements else "")
    if types and elements:
        rules = rules.replace("assertion = '<' type '>'\n", "")
    names = {"ID", *CONTEXTUAL}
    return Grammar(rules, "file", {"ID": names, "WORD": names | RESERVED, "BINARY": BINARY if not types else BINARY - {">>", ">>>"} | {"RIGHT"}, "ASSIGN": ASSIGN})


def check(text: str, types: bool, elements: bool) -> tuple[int, str] | None:
    """None if ``text`` parses, else (offset, kind): kind is "syntax" at the token that cannot stand there, or "truncated"."""
    g = grammar(types, elements)
    if g.full():
        g.reset()
    empty, state, step, match = g.empty, g.start, g.step, _TOKEN.match
    at, n = 0, len(text)
    if text.startswith("#!"):
        at = text.find("\n")
        if at < 0:
            return None
    open_: list[str] = []  # "{", "$" in a template, "<" between tags, "T" in a tag
    tags: list[str] = []
    before = ""
    while True:
        if open_ and open_[-1] in "<T":
            # inside an element: text and tags have tokens of their own
            if open_[-1] == "<":
                m = _TEXT.match(text, at)
                if m.end() > at:
                    state, at = step(state, "JTEXT"), m.end()
                if at >= n:
                    return n, "truncated"
                if text.startswith("</", at):
                    m = _CLOSE.match(text, at)
                    if not m:
                        return at, "truncated" if ">" not in text[at:] else "syntax"
                    if m[1] != tags.pop():
                        return at, "syntax"
                    for token in ("J</", *(("JNAME",) if m[1] else ()), "J>"):
                        state = step(state, token)
                    open_.pop()
                elif text[at] == "<":
                    state = step(state, "J<")
                    open_.append("T")
                    tags.append(None)
                    m = re.compile(r"<").match(text, at)
                elif text[at] == "{":
                    state = step(state, "{")
                    open_.append("{")
                    m = re.compile(r"\{").match(text, at)
                else:
                    return at, "syntax"
                if state is empty:
                    return at, "syntax"
                at = m.end()
                before = "J"
                continue
            m = _TAG.match(text, at)
            if not m:
                return (n, "truncated") if not text[at:].strip() or re.match(r"\s*[\"']", text[at:]) else (at, "syntax")
            if m["name"]:
                if tags[-1] is None and before == "J":
                    tags[-1] = m["name"]
                state, before = step(state, "JNAME"), "N"
            elif m["string"]:
                state = step(state, "STR")
            elif m["op"]:
                op = m["op"]
                if op == ">":
                    state = step(state, "J>")
                    tags[-1] = tags[-1] or ""
                    open_[-1] = "<"
                elif op[0] == "/":
                    state = step(state, "J/>")
                    open_.pop()
                    tags.pop()
                elif op == "{":
                    state = step(state, "{")
                    open_.append("{")
                elif op == "<":
                    state, before = step(state, "J<"), "J"
                    open_.append("T")
                    tags.append(None)
                    at = m.end()
                    continue
                else:
                    state = step(state, op)
            if state is empty:
                return at, "syntax"
            at = m.end()
            before = "N"
            continue
        m = match(text, at)
        if m is None:
            m = re.compile(r"(?:\s|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)*+").match(text, at)
            return m.end(), "truncated" if text[m.end() : m.end() + 1] == "`" or text.startswith("/*", m.end()) else "syntax"
        kind, space = m.lastgroup, m["space"]
        line = bool(space) and ("\n" in space or "\r" in space or "\u2028" in space)
        start, stop = m.end("space"), m.end()
        if kind == "word":
            token = m["word"]
            if token not in RESERVED and token not in CONTEXTUAL:
                token = "ID"
        elif kind == "op":
            token = m["op"]
            if token == "{":
                open_.append("{")
            elif token == "}":
                if open_ and open_[-1] == "$":
                    m = _TEMPLATE_GO_ON.match(text, start)
                    if not m:
                        return n, "truncated"
                    stop = m.end()
                    if text[stop - 1] == "`":
                        open_.pop()
                        token = "TAIL"
                    else:
                        token = "MIDDLE"
                elif open_:
                    open_.pop()
            elif token == "<" and elements and _OPENS_ELEMENT.match(text, start):
                go = step(state, "J<")
                if go is not empty and not (types and _OPENS_TYPE_PARAMS.match(text, start)):
                    state, at, before = go, start + 1, "J"
                    open_.append("T")
                    tags.append(None)
                    continue
            elif token in ("++", "--"):
                if not line and step(state, "POST") is not empty:
                    token = "POST"
            elif types and token[0] == ">" and len(token) > 1 and token[1] == ">":
                # a run of closing angle brackets: one by one where types end, else a shift
                if step(state, ">") is not empty and step(step(state, ">"), ">") is not empty:
                    token, stop = ">", start + 1
                elif not token.endswith("="):
                    token = "RIGHT"
        elif kind == "string":
            token = "STR"
        elif kind == "number":
            token = "NUM"
            if re.match(r"[\w$]", text[stop : stop + 1]):
                return start, "syntax"
        elif kind == "template":
            if text[stop - 1] == "{" and text[stop - 2] == "$":
                token = "HEAD"
                open_.append("$")
            else:
                token = "TEMPLATE"
        elif kind == "slash":
            token = m["slash"]
            if step(state, token) is empty:
                m = _REGEX.match(text, start)
                if not m:
                    return start, "syntax"
                token, stop = "REGEX", m.end()
        elif kind == "private":
            token = "PRIVATE"
        else:
            token = ""
        if line and before in _RESTRICTED and (auto := step(state, "AUTO")) is not empty:
            state = auto
        if not token:
            break
        nxt = state.d.get(token) or step(state, token)
        if nxt is empty:
            if line or token == "}":
                nxt = step(step(state, "AUTO"), token)
            if nxt is empty and token == "POST":
                nxt = step(step(state, "AUTO"), "++")
            if nxt is empty:
                return start, "syntax"
        state, at, before = nxt, stop, token
    if state.null or step(state, "AUTO").null:
        return None
    return n, "truncated"
