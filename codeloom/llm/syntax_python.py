"""Syntax check of Python 3.10 or later: grammar and token stream for the derivative parser."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from .derivatives import Grammar

RULES = """
file = (NEWLINE | statement)*
statement = simple_line | if | while | for | try | with | decorated | match
simple_line = simple (';' simple)* ';'? NEWLINE
block = simple_line | NEWLINE INDENT statement+ DEDENT
simple = expr_statement | 'pass' | 'break' | 'continue' | 'return' list? | 'raise' (expr ('from' expr)?)? | 'del' erased (',' erased)* ','? | 'assert' expr (',' expr)?
 | ('global' | 'nonlocal') ID (',' ID)* | 'import' dotted ('as' ID)? (',' dotted ('as' ID)?)* | 'from' ('.' | '...')* dotted 'import' names
 | 'from' ('.' | '...')+ 'import' names | 'type' ID type_params? '=' expr | yield
dotted = ID ('.' ID)*
names = '*' | name_as (',' name_as)* | '(' name_as (',' name_as)* ','? ')'
name_as = ID ('as' ID)?
expr_statement = list | (targets '=')+ right | single AUGMENTED right | single ':' expr ('=' right)?
right = list | yield
yield = 'yield' (list? | 'from' expr)
# what may be assigned to
targets = target (',' target)* ','?
target = '*'? bare_target
bare_target = ID | part | '(' targets? ')' | '[' targets? ']'
part = atom trailer* ('.' ID | subscript)
single = ID | part | '(' single ')'
erased = ID | part | '(' (erased (',' erased)* ','?)? ')' | '[' (erased (',' erased)* ','?)? ']'
# expressions
list = starred (',' starred)* ','?
starred = '*' bits | expr
item = '*' bits | named
named = ID ':=' expr | expr
expr = chain ('if' chain 'else' expr)? | 'lambda' lambda_params? ':' expr
chain = 'not'* comparison (('and' | 'or') 'not'* comparison)*
comparison = bits (compared bits)*
compared = COMPARED | 'not' 'in' | 'is' 'not'?
bits = operand (BITS operand)*
operand = ('-' | '+' | '~')* 'await'? primary ('**' ('-' | '+' | '~')* 'await'? primary)*
primary = atom trailer*
trailer = '.' ID | '(' (named comprehension | args)? ')' | subscript
subscript = '[' slice (',' slice)* ','? ']'
slice = named | expr? ':' expr? (':' expr?)? | '*' bits
atom = ID | NUMBER | (STRING | fstring)+ | BYTES+ | 'None' | 'True' | 'False' | '...' | '(' paren? ')' | '[' items? ']' | '{' (map | items)? '}'
paren = yield | named comprehension? | item ',' (item (',' item)* ','?)?
items = named comprehension | item (',' item)* ','?
map = expr ':' expr comprehension | pair (',' pair)* ','?
pair = '**' bits | expr ':' expr
comprehension = ('async'? 'for' targets 'in' chain ('if' chain)*)+
fstring = 'F<' field* 'F>'
field = 'F{' (yield | list) '='? ('!' ID)? (':' field*)? 'F}'
# arguments: names behind values, two stars behind names
args = (named | '*' expr) (',' args?)? | named_args
named_args = ID '=' expr (',' mixed_args?)? | '**' expr (',' late_args?)?
mixed_args = '*' expr (',' mixed_args?)? | named_args
late_args = (ID '=' expr | '**' expr) (',' late_args?)?
# parameters: defaults behind plain ones, one slash, one star, two stars last
params = plain (',' params_1?)? | default (',' params_2?)? | star_params
params_1 = plain (',' params_1?)? | '/' (',' params_3?)? | default (',' params_2?)? | star_params
params_2 = default (',' params_2?)? | '/' (',' params_4?)? | star_params
params_3 = plain (',' params_3?)? | default (',' params_4?)? | star_params
params_4 = default (',' params_4?)? | star_params
star_params = '*' ID (':' starred)? (',' key_params?)? | '*' ',' key_param (',' key_params?)? | kwargs
key_params = key_param (',' key_params?)? | kwargs
kwargs = '**' ID (':' expr)? ','?
plain = ID (':' expr)?
default = ID (':' expr)? '=' expr
key_param = plain | default
lambda_params = ID (',' lambda_1?)? | lambda_default (',' lambda_2?)? | lambda_star
lambda_1 = ID (',' lambda_1?)? | '/' (',' lambda_3?)? | lambda_default (',' lambda_2?)? | lambda_star
lambda_2 = lambda_default (',' lambda_2?)? | '/' (',' lambda_4?)? | lambda_star
lambda_3 = ID (',' lambda_3?)? | lambda_default (',' lambda_4?)? | lambda_star
lambda_4 = lambda_default (',' lambda_4?)? | lambda_star
lambda_star = '*' ID (',' lambda_keys?)? | '*' ',' lambda_key (',' lambda_keys?)? | '**' ID ','?
lambda_keys = lambda_key (',' lambda_keys?)? | '**' ID ','?
lambda_default = ID '=' expr
lambda_key = ID ('=' expr)?
type_params = '[' type_param (',' type_param)* ','? ']'
type_param = ('*' | '**')? ID (':' expr)? ('=' starred)?
# compound statements
decorated = ('@' named NEWLINE)* (def | class)
def = 'async'? 'def' ID type_params? '(' params? ')' ('->' expr)? ':' block
class = 'class' ID type_params? ('(' args? ')')? ':' block
if = 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)?
while = 'while' named ':' block ('else' ':' block)?
for = 'async'? 'for' targets 'in' list ':' block ('else' ':' block)?
with = 'async'? 'with' (with_item (',' with_item)* | '(' with_item (',' with_item)* ','? ')') ':' block
with_item = expr ('as' target)?
try = 'try' ':' block (handlers ('else' ':' block)? ('finally' ':' block)? | 'finally' ':' block)
handlers = ('except' (expr ('as' ID)?)? ':' block)+ | ('except' '*' expr ('as' ID)? ':' block)+
match = 'match' item (',' item)* ','? ':' NEWLINE INDENT ('case' patterns ('if' named)? ':' block)+ DEDENT
patterns = pattern (',' pattern)* ','?
pattern = '*' ID | closed ('|' closed)* ('as' ID)?
closed = ('-')? NUMBER (('+' | '-') NUMBER)? | (STRING | fstring)+ | BYTES+ | 'None' | 'True' | 'False' | ID ('.' ID)* ('(' pattern_args? ')')?
 | '(' patterns? ')' | '[' patterns? ']' | '{' (pattern_pair (',' pattern_pair)* ','?)? '}'
pattern_args = pattern (',' pattern_args?)? | named_patterns
named_patterns = ID '=' pattern (',' named_patterns?)?
pattern_pair = '**' ID | closed ':' pattern
"""

# fixed values: the language's keywords and operators
KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is "
    "lambda nonlocal not or pass raise return try while with yield".split()
)
SOFT = frozenset("match case type".split())
BITS = frozenset("+ - * / // % @ & | ^ << >>".split())
COMPARED = frozenset("== != < > <= >= in".split())
AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= <<= >>= **=".split())

_PREFIX = r"(?:[bB][rR]|[rR][bB]|[rRuUbB])?"
_FORMAT = r"(?:[fFtT][rR]|[rR][fFtT]|[fFtT])"
_TOKEN = re.compile(
    rf"""(?:[ \t\f]|\\\r?\n)*+(?:
    (?P<fstart>{_FORMAT}(?:\"\"\"|\'\'\'|"|\'))
   |(?P<string>{_PREFIX}(?:\"\"\"(?:[^"\\]|\\.|"(?!""))*+\"\"\"|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*+\'\'\'|(?!\"\"\"|\'\'\')(?:"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\')))
   |(?P<name>[^\W\d]\w*+)
   |(?P<number>(?:0[xX](?:_?[0-9a-fA-F])++|0[bB](?:_?[01])++|0[oO](?:_?[0-7])++|(?:(?:[0-9](?:_?[0-9])*+)?\.[0-9](?:_?[0-9])*+|[0-9](?:_?[0-9])*+\.?)(?:[eE][+-]?[0-9](?:_?[0-9])*+)?[jJ]?)(?P<after>\w?))
   |(?P<newline>(?:\#[^\n]*+)?(?:\r?\n|\r))
   |(?P<comment>\#[^\n]*+)
   |(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|<<|>>|<=|>=|==|!=|->|:=|[-+*/%@&|^]=|[-+*/%@&|^~<>()\[\]{{}},:.;=!])
   |(?P<end>\Z)
    )""",
    re.VERBOSE | re.DOTALL,
)
_INDENT = re.compile(r"(?:[ \t\f]*+(?:\#[^\n]*+)?(?:\r?\n|\r))*+([ \t\f]*+)")
_JOINED = frozenset("if else and or in is for not".split())
_ESCAPES = re.compile(r"(?s)(?:[^\\]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4}|N\{[^{}\n]+\}|[^xuUN]))*+\Z")
_BYTE_ESCAPES = re.compile(r"(?s)(?:[^\\]|\\(?:x[0-9a-fA-F]{2}|[^x]))*+\Z")


@cache
def _literal(quote: str, raw: bool, spec: bool) -> re.Pattern:
    """Text of a formatted string up to a field, its end, or what cannot stand there."""
    other = rf"{quote[0]}(?!{quote[0] * 2})" if len(quote) == 3 else r"(?!)"
    line = "" if len(quote) == 3 else r"\n"
    escape = r"\\[^{}]|\\" if raw else r"\\N\{[^{}\n]*+\}|\\[^{}]|\\(?=[{}])"
    doubled = r"(?!)" if spec else r"\{\{|\}\}"
    return re.compile(rf"(?s)(?:[^\\{{}}{quote[0]}{line}]|{escape}|{other}|{doubled})*+")


def _bad_text(text: str, data: bool = False) -> bool:
    """Whether a literal (not a raw one) holds a broken escape, or bytes other than ASCII."""
    if data and not text.isascii():
        return True
    if "\\" not in text:
        return False
    if not (_BYTE_ESCAPES if data else _ESCAPES).match(text):
        return True
    if data or "\\N{" not in text:
        return False
    for name in re.findall(r"(?<!\\)(?:\\\\)*\\N\{([^{}]+)\}", text):
        try:
            unicodedata.lookup(name)
        except KeyError:
            return True
    return False


@cache
def grammar() -> Grammar:
    return Grammar(RULES, "file", {"ID": {"ID", *SOFT}, "BITS": BITS, "COMPARED": COMPARED, "AUGMENTED": AUGMENTED})


def check(text: str) -> tuple[int, str] | None:
    """None if ``text`` parses, else (offset, kind): kind is "syntax" at the token that cannot stand there, or "truncated".

    Fields of formatted strings are read by the same grammar. Indents are compared under two widths of a tab, as the language does.
    """
    g = grammar()
    if g.full():
        g.reset()
    text = text.removeprefix("\ufeff")
    empty, state, step = g.empty, g.start, g.step
    match, n = _TOKEN.match, len(text)
    depth, indents, at, fresh = 0, [(0, 0)], 0, True
    modes: list[tuple] = []  # of formatted strings: ("text", quote, raw, whether it is a format) and ("field", depth of brackets)
    while True:
        if modes and modes[-1][0] == "text":
            _, quote, raw, spec = modes[-1]
            m = _literal(quote, raw, spec).match(text, at)
            if not raw and _bad_text(m[0]):
                return at, "syntax"
            at = m.end()
            if text.startswith(quote, at) and not spec:
                token, at = "F>", at + len(quote)
                modes.pop()
            elif text.startswith("{", at):
                token, at = "F{", at + 1
                modes.append(("field", depth))
            elif spec and text.startswith("}", at):
                token, at = "F}", at + 1
                modes.pop()
                modes.pop()
            else:
                return (n, "truncated") if at >= n else (at, "syntax")
            nxt = state.d.get(token) or step(state, token)
            if nxt is empty:
                return at - 1, "syntax"
            state = nxt
            continue
        if fresh and not depth and not modes:
            m = _INDENT.match(text, at)
            at = m.end()
            if at < n and text[at] != "#":
                blanks = m[1].rpartition("\f")[2]
                width = len(blanks.expandtabs(8)), len(blanks)
                if width[0] > indents[-1][0]:
                    if width[1] <= indents[-1][1]:
                        return at, "syntax"
                    indents.append(width)
                    tokens = ("INDENT",)
                else:
                    tokens = ()
                    while width[0] < indents[-1][0]:
                        indents.pop()
                        tokens += ("DEDENT",)
                    if width != indents[-1]:
                        return at, "syntax"
                for token in tokens:
                    state = state.d.get(token) or step(state, token)
                    if state is empty:
                        return at, "syntax"
            fresh = False
        m = match(text, at)
        if m is None:
            rest = text[at:].lstrip(" \t\f")
            where = n - len(rest)
            return where, "truncated" if rest[:3] in ('"""', "'''") or re.match(r"[a-zA-Z]{1,2}(?:\"\"\"|''')", rest) else "syntax"
        kind = m.lastgroup
        stop = m.end()
        if kind == "name":
            token = m["name"]
            if token not in KEYWORDS and token not in SOFT:
                if not token.isascii() and not token.isidentifier():
                    return m.start("name"), "syntax"
                token = "ID"
        elif kind == "op":
            token = m["op"]
            if modes and depth == modes[-1][1] and token in ("}", ":", ":=", "!"):
                if token == "}":
                    token = "F}"
                    modes.pop()
                elif token == "!":
                    if not re.compile(r"[rsa](?!\w)").match(text, stop):
                        return m.start("op"), "syntax"
                else:
                    token, stop = ":", m.start("op") + 1
                    _, quote, raw, _ = modes[-2]
                    modes.append(("text", quote, raw, True))
            elif token in "([{":
                depth += 1
            elif token in ")]}":
                depth = max(0, depth - 1)
        elif kind == "string":
            token = "STRING"
            word = m["string"]
            head = word[: min(i for i in (word.find('"'), word.find("'")) if i >= 0)].lower()
            if "b" in head:
                token = "BYTES"
            if not word.isascii() and token == "BYTES" or "r" not in head and "\\" in word and _bad_text(word, token == "BYTES"):
                return m.start("string"), "syntax"
        elif kind == "fstart":
            token = "F<"
            word = m["fstart"]
            quote = word.lstrip("fFrRtT")
            if len(quote) == 1 and text.startswith(quote * 2, stop):
                quote, stop = quote * 3, stop + 2
            modes.append(("text", quote, "r" in word.lower(), False))
        elif kind == "number":
            token = "NUMBER"
            if m["after"]:
                stop -= 1
                if re.compile(r"\w+").match(text, stop)[0] not in _JOINED:
                    return m.start("number"), "syntax"
            if re.fullmatch(r"0[0-9_]*[1-9][0-9_]*", text[m.start("number") : stop]):
                return m.start("number"), "syntax"
        elif kind == "newline":
            at = stop
            if depth or modes:
                continue
            token, fresh = "NEWLINE", True
            nxt = state.d.get(token) or step(state, token)
            if nxt is empty:
                return m.start("newline"), "syntax"
            state = nxt
            continue
        elif kind == "comment":
            at = stop
            continue
        else:
            break
        nxt = state.d.get(token) or step(state, token)
        if nxt is empty:
            return m.start(kind), "syntax"
        state, at = nxt, stop
    if depth or modes:
        return n, "truncated"
    for token in ("NEWLINE", *["DEDENT"] * (len(indents) - 1)):
        nxt = step(state, token)
        if nxt is empty:
            if token == "NEWLINE" and state is not empty:
                if indents[-1][0] or not state.null:
                    nxt = state  # the text ended behind a line break
                else:
                    continue
            else:
                return n, "truncated"
        state = nxt
    return None if state.null else (n, "truncated")
