"""Credentials in source code and configuration: found with byte offsets and blanked out in place.

Configuration texts are parsed into key paths with the offsets of their values; in source code the string literals and comments
are read with the name they are bound to. A value is a credential if its shape says so by itself (private keys, issued tokens,
passwords in connection strings), or if its name is sensitive and its shape is that of a secret rather than of a placeholder,
mask, reference or identifier. Redactions replace the secret's characters one by one, so all other bytes stay where they were.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import config_formats
from .languages import EXTENSIONS

SCHEMA = "id string, repository_id string, file_path string, line_no int, key_path string, kind string, byte_start long, byte_end long"

# fixed values: words of names, in several languages
_PASSWORD = {"password", "passwd", "passphrase", "passcode", "pwd", "passwort", "kennwort", "motdepasse", "depasse", "passe", "mdp", "contrasena", "contraseña", "clave", "senha", "parol", "пароль", "wachtwoord", "haslo", "heslo"}
_SECRET = {"secret", "secrets", "token", "tokens", "credential", "credentials", "creds", "cred", "apikey", "accesskey", "secretkey", "authkey", "privatekey", "signingkey", "masterkey", "hmackey", "encryptionkey", "sessionkey", "clientsecret", "authtoken", "accesstoken", "refreshtoken", "bearer", "authorization", "jeton", "geheimnis", "segreto", "secreto"}
_WEAK = {"pass", "pw", "key", "keys", "auth", "pin", "salt", "seed", "cookie", "sig", "signature", "pat", "schluessel", "llave", "cle", "pem", "login"}
_QUALIFIERS = {"api", "access", "secret", "auth", "private", "signing", "master", "hmac", "encryption", "session", "client", "service", "account", "aws", "ssh", "webhook"}
_NEGATIVE = {
    "id", "ids", "ttl", "url", "uri", "field", "fields", "prompt", "hint", "label", "name", "names", "file", "path", "dir", "length", "len", "size", "policy", "expiry", "expires", "expiration", "count", "type",
    "types", "kind", "regex", "pattern", "min", "max", "format", "algorithm", "alg", "digest", "checksum", "hash", "integrity", "fingerprint", "commit", "uuid", "guid", "etag", "public", "endpoint", "host", "issuer", "audience", "scope",
    "scopes", "version", "enabled", "required", "placeholder", "message", "error", "title", "text", "help", "description", "column", "index", "prefix", "suffix", "timeout", "limit", "provider", "store", "ref", "env", "var", "variable", "icon", "image", "sha", "sha1", "sha256", "sha512", "md5", "rotation", "days", "revision", "address", "link", "page", "input", "selector", "class", "test",
}
_NOT_PASS = re.compile(r"(?:by|com|sur|tres|over|under|en)pass$|(?:mon|tur|don|hoc|joc|whis|mic|lac|dis)key$")
_SUFFIXED = re.compile(r"(?:clave(?:api|secreta)?|contrase[nñ]a|senha|password|passwd|passphrase|passwort|kennwort|motdepasse|pwd|secret|apikey|token|credentials?|secretkey|accesskey|authkey|hmackey)$")
_SPLIT = re.compile(r"[A-ZÀ-Þ]+(?=[A-ZÀ-Þ][a-zß-ÿ])|[A-ZÀ-Þ]?[a-zß-ÿ]+|[A-ZÀ-Þ]+|[а-яё]+|\d+")

_PLACEHOLDER = re.compile(
    r"""(?ix)^(?:
     [x*.\-_\#0?•…\s]+ | (.)\1{3,} | 0?123456?7?8?9?0? | abc(?:def)?(?:123)?
    |<.*> | \[.*\] | \{.*\} | \$.* | %.*% | %\(.*\)s | @.*@ | \#\{.*\} | .*\$\{.*\}.* | .*\{\{.*\}\}.*
    |.*(?:change[-_ ]?(?:me|it|this)|set[-_ ]?me|fill[-_ ]?(?:me|in)|replace[-_ ]?(?:me|this|with)|place[-_ ]?holder|redacted|masked|dummy|your[-_ ]|example|sample|insert[-_ ]|todo|fixme|tbd|notset|not[-_ ]set|unset|lorem|xxxx|\*\*\*\*|goes[-_ ]here|to[-_ ]be[-_ ]|here$).*
    |(?:none|null|nil|undefined|true|false|yes|no|on|off|empty|default|test|testing|foo|bar|baz|foobar|secret|password|passwd|pwd|passphrase|token|key|api[-_]?key|credentials?|n/?a|unknown|user|username|admin|root|guest|public|private|string|text|hidden|required|optional|basic|bearer|hunter)
    |(?:vault|env|ssm|sm|secret|secrets|secretsmanager|kms|keyring|keychain|keyvault|file|op|aws-sm|gcp-sm|sops|ref|ref\+\w+|akv|doppler|infisical|conjur|lookup|param|config|k8s)\s*[:(].*
    |arn:.* | \.{0,2}/[\w./@\-]* | ~/.* | !.* | (?:os|process|sys|config|settings|env|self|this)\.\w.*
    )$""",
)
_HOST = re.compile(r"(?i)^(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}(?::\d+)?(?:/\S*)?$|^\d+(?:\.\d+){3}(?::\d+)?$|^localhost(?::\d+)?$")
_URL = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
_DIGEST = re.compile(r"(?i)^(?:sha\d+|md5)[:\-]|^data:")
# fixed values: how images, fonts, sounds, documents and archives begin in base64
_MEDIA = re.compile(r"iVBORw0KGgo|/9j/|R0lGOD|UklGR|Qk0[2-9]|PHN2Zy|PD94bW|d09G[MR]|AAEAAAA|T1RUTw|JVBERi0|UEsDB|H4sI|SUQz|T2dnUw|AGFzbQ|AAABAAE")
_HEX = re.compile(r"^(?:[0-9a-f]{24,}|[0-9A-F]{24,})$")
_TOKENISH = re.compile(r"^[A-Za-z0-9+/_=.~-]+$")

_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(.*?)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|(?=-----BEGIN )|(?=[\"'`](?:[^A-Za-z0-9+/]|$))|\Z)", re.DOTALL)
# fixed values: shapes of issued tokens
_ISSUED = re.compile(
    r"""(?x)(?<![A-Za-z0-9])(?:
     (?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,} | sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,} | gh[pousr]_[A-Za-z0-9]{30,} | github_pat_[A-Za-z0-9_]{22,} | glpat-[A-Za-z0-9_-]{16,} | xox[abeoprs]-[A-Za-z0-9-]{16,}
    |(?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16} | AIza[0-9A-Za-z_-]{35} | ya29\.[0-9A-Za-z_-]{20,} | npm_[A-Za-z0-9]{36} | pypi-[A-Za-z0-9_-]{16,} | SG\.[\w-]{16,}\.[\w-]{16,} | dop_v1_[0-9a-f]{64} | hf_[A-Za-z0-9]{30,}
    |eyJ[A-Za-z0-9_-]{8,}={0,2}\.eyJ[A-Za-z0-9_-]{6,}={0,2}\.[A-Za-z0-9_-]{10,}
    |[a-z]{2,6}[_-](?:pat|sec|key|tok|token|prod|live|secret|api|svc|auth|sk)[_-](?=[A-Za-z0-9]*[A-Z])(?=[A-Za-z0-9]*[a-z])(?:(?=[A-Za-z0-9]*\d)[A-Za-z0-9]{16,}|(?=(?:[A-Za-z]*?[a-z][A-Z]){5})[A-Za-z]{24,})
    )(?![A-Za-z0-9])""",
)
_USERINFO = re.compile(r"(?i)\b[a-z][a-z0-9+.-]*://[^\s/:@\"'`<>]*:([^\s/@\"'`<>]+)@(?=[\w\[])")
_QUERY = re.compile(r"(?i)[?&](?:[\w.-]*(?:token|key|secret|sig|signature|password|passwd|pwd|auth|code|credential)[\w.-]*)=([^\s&#\"'`<>]+)")
_BASIC = re.compile(r"\bBasic\s+([A-Za-z0-9+/]{8,}={0,2})(?![A-Za-z0-9+/=])")
_BEARER = re.compile(r"\b(?:Bearer|Token|ApiKey|Api-Key)\s+([^\s\"'`,;]{8,})")
_PAIR = re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|accountkey|accesskey|sharedaccesskey)\s*=\s*([^\s;&\"'`,]{6,})")
_CURL = re.compile(r"(?:\s|^)(?:-u|--user|--login)[ =]+[\"']?[^\s:\"'@/]+:([^\s\"'@]{4,})")
_FLAG = re.compile(r"(?i)\s--?(?:password|passwd|pass|token|secret|api-?key)[ =]+[\"']?([^\s\"'-][^\s\"']{5,})")
_COMMENT_WORD = re.compile(r"(?i)passw|passphrase|\bpass\b|\bpwd\b|\bpw\b|\btokens?\b|\bkeys?\b|secret|credential|\blogin\b|\bbearer\b|\bauth|\baccess\b|kennwort|mot de passe|contrase|clave|пароль")
_COMMENT_NOT = re.compile(r"(?i)\b(?:commit|sha\d*|digest|checksum|hash|integrity|revision|etag|uuid|fingerprint|public key|key id|version)\b")
_COMMENT_WORDS, _COMMENT_NOTS = (re.compile(f"(?i)(?=({p.pattern.removeprefix('(?i)')}))") for p in (_COMMENT_WORD, _COMMENT_NOT))
_VALUE = re.compile(r"[^\s\"'`,;()<>]{6,}")


def words(name: str) -> list[str]:
    """Words of a name in snake, kebab or camel case, in lower case."""
    return [w.lower() for w in _SPLIT.findall(name)]


def sensitivity(name: str) -> int:
    """2 if a name surely stands for a credential, 1 if it may, else 0."""
    parts = [w for w in words(name) if not w.isdigit()]
    if not parts:
        return 0
    joined = "".join(parts[-2:])
    last = parts[-1]
    if last in _NEGATIVE and not (last == "test" and len(parts) > 1):
        return 0
    if "public" in parts:
        return 0
    if last in _PASSWORD or last in _SECRET or joined in _SECRET or (last.endswith("s") and last[:-1] in _PASSWORD):
        return 2
    if _SUFFIXED.search(last) and not _NOT_PASS.search(last):
        return 2
    if last in ("key", "keys") and len(parts) > 1 and parts[-2] in _QUALIFIERS:
        return 2
    if last in _WEAK or (last.endswith(("pass", "key", "pw")) and not _NOT_PASS.search(last)):
        return 1
    if any(p in _PASSWORD or p in _SECRET or _SUFFIXED.search(p) for p in parts):
        return 1
    return 0


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if n else 0.0


def is_placeholder(value: str) -> bool:
    """Placeholders, masks and references to variables or secret stores."""
    return not value or bool(_PLACEHOLDER.match(value))


def classes(value: str) -> int:
    return sum((any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value), any(not c.isalnum() for c in value)))


def _mixed(value: str) -> bool:
    """Letters whose case changes as it does at random, not as in names."""
    return len(value) >= 16 and len(re.findall(r"[a-z][A-Z]", value)) >= 0.12 * len(value) and len(re.findall(r"[A-Z]{2}", value)) >= 2 and entropy(value) >= 3.5


def secretish(value: str) -> bool:
    """Shaped like a made-up or random secret: at least three classes of characters with a digit, or long hexadecimal."""
    if len(value) < 6 or any(c.isspace() for c in value) or is_placeholder(value) or _HOST.match(value) or _URL.match(value) or _DIGEST.match(value) or (len(value) > 100 and _MEDIA.match(value)):
        return False
    if _HEX.match(value):
        return True
    if _UUID.match(value) or re.match(r"^v?\d+(?:\.\d+)+", value) or re.match(r"^[\d:.,TZ+\-/]+$", value) or re.match(r"^[\w.$]+\(.*\)?$", value):
        return False
    digits = sum(c.isdigit() for c in value)
    if not digits or classes(value) < 3:
        return len(value) >= 20 and bool(_TOKENISH.match(value)) and digits >= 2 and entropy(value) >= 3.6
    return len(value) >= 8


def random_looking(value: str) -> bool:
    """A run of at least twelve letters of both cases and digits, or long hexadecimal: a secret also where the name says little."""
    return secretish(value) and (bool(_HEX.match(value)) or (len(value) >= 12 and bool(_TOKENISH.match(value)) and any(c.islower() for c in value) and any(c.isupper() for c in value) and any(c.isdigit() for c in value)))


# fixed values: passwords of letters that many people use
_COMMON = frozenset(
    "letmein sunshine princess iloveyou football baseball monkey dragon shadow superman batman michael jennifer charlie freedom whatever qwertyuiop qwerty asdfgh "
    "asdfghjkl zxcvbnm welcome master ashley jessica jordan hannah daniel starwars computer cheese pepper ginger summer winter mustang corvette ferrari liverpool "
    "chelsea arsenal barcelona hottie lovely flower cookie chocolate butterfly correcthorse correcthorsebatterystaple trustme opensesame swordfish".split()
)
_PROSE = frozenset("a an the your you my our is are be must not no at to for of and or in on with please enter type choose set new old this that here it key token secret password passphrase passwort".split())


def spoken(value: str, key: str) -> bool:
    """Passwords of letters, under a name that says password: ones that many people use, and phrases of four plain words or more."""
    if not any(w in _PASSWORD or (w.endswith("s") and w[:-1] in _PASSWORD) or _SUFFIXED.search(w) for w in words(key)[-1:]):
        return False
    parts = value.split(" ")
    return value.lower() in _COMMON or (len(parts) >= 4 and all(re.fullmatch(r"[a-z]{3,}", p) and p not in _PROSE for p in parts))


def plausible(value: str, level: int, key: str = "") -> bool:
    """Whether ``value`` may be the secret of a name of sensitivity ``level``."""
    if level == 2 and spoken(value, key):
        return True
    if len(value) < 4 or any(c.isspace() for c in value) or is_placeholder(value) or _HOST.match(value) or _DIGEST.match(value) or (len(value) > 100 and _MEDIA.match(value)):
        return False
    if _URL.match(value):
        return False  # only its user info or query may be secret
    if level < 2:
        return secretish(value)
    if re.match(r"^[\w.$]+\(.*\)$", value):
        return False
    if value.isdigit():
        return len(value) >= 6
    if re.match(r"^[a-z]+(?:[-_. ][a-z]+)*$|^[A-Z]+(?:[_-][A-Z]+)*$|^[A-Za-z]+$", value):
        return len(value) >= 12 and entropy(value) >= 3.3 and not re.search(r"(?i)pass|secret|token|key|cred|auth", value) and not re.search(r"[-_. ]", value)
    return classes(value) >= 2


#: A mark of settings with a value of a secret's length behind it.
_SETTING = re.compile(r"""[=:][ \t]*["'\\]{0,2}[^\s"'\\,;(){}\[\]<>]{4}|[\[{]""")
_REFERENCE = re.compile(r"^[a-z_]+(?:\.[a-z_]+)+$")

Span = tuple[int, int, str, str]  # start, end, key path, kind


def _by_shape(text: str, start: int, end: int, key: str) -> Iterator[Span]:
    """Credentials that their shape gives away, within text[start:end]."""
    piece = text[start:end]
    for m in _ISSUED.finditer(piece):
        if not re.search(r"(?i)example|xxxx|0{8}|placeholder|redacted", m[0]):
            yield start + m.start(), start + m.end(), key, "issued token"
    if "://" in piece:
        for m in _USERINFO.finditer(piece):
            if not is_placeholder(m[1]) and len(m[1]) >= 3:
                yield start + m.start(1), start + m.end(1), key, "password in address"
        for m in _QUERY.finditer(piece):
            if secretish(m[1]) or (len(m[1]) >= 16 and not is_placeholder(m[1]) and entropy(m[1]) >= 3.2 and (any(c.isdigit() for c in m[1]) or _mixed(m[1]))):
                yield start + m.start(1), start + m.end(1), key, "key in address"
    if "Basic" in piece:
        for m in _BASIC.finditer(piece):
            try:
                user, _, secret = base64.b64decode(m[1] + "=" * (-len(m[1]) % 4), validate=True).decode().partition(":")
            except (binascii.Error, UnicodeDecodeError):
                continue
            if user and len(secret) >= 3 and not is_placeholder(secret) and (user + secret).isprintable():
                yield start + m.start(1), start + m.end(1), key, "basic credentials"
    for m in _BEARER.finditer(piece):
        if plausible(m[1], 2) and secretish(m[1]):
            yield start + m.start(1), start + m.end(1), key, "bearer token"
    if "=" in piece and ";" in piece or "-" in piece:
        for pattern in (_PAIR, _CURL, _FLAG):
            for m in pattern.finditer(piece):
                if plausible(m[1], 2) and (secretish(m[1]) or pattern is _CURL):
                    yield start + m.start(1), start + m.end(1), key, "setting in text"


def _around(pattern: re.Pattern, line: str) -> tuple[int, int]:
    """End of the first and start of the last match: one lies outside of a stretch if it is before or behind it."""
    ends, last = len(line) + 1, -1
    for m in pattern.finditer(line):
        ends, last = min(ends, m.end(1)), m.start(1)
    return ends, last


def _in_comment(text: str, start: int, end: int) -> Iterator[Span]:
    for m in re.compile(r"[^\n]+").finditer(text, start, end):
        line = m[0]
        yield from _by_shape(text, m.start(), m.end(), "")
        if not _COMMENT_WORD.search(line):
            continue
        word, not_ = _around(_COMMENT_WORDS, line), _around(_COMMENT_NOTS, line)
        for v in _VALUE.finditer(line):
            a, b = v.span()  # a secret may itself hold such words
            if not (word[0] <= a or word[1] >= b) or not_[0] <= a or not_[1] >= b:
                if not re.match(r"[\w-]+[=:]", v[0]):
                    continue
            if line.endswith("base64,", 0, a):
                continue
            value = v[0].strip(".*/:=!?")
            at = v.start() + v[0].find(value) if value else v.start()
            for mark in ("=", ":"):
                head, found, tail = value.partition(mark)
                if found and tail and re.fullmatch(r"[\w-]+", head) and sensitivity(head):
                    at += len(head) + 1
                    value = tail
                    break
            if secretish(value) and not re.match(r"^(?:https?:|[\w.-]+@|[\w./-]+/[\w./-]+\.\w+$|@\w)", value) and not re.match(r"^[a-z]+(?:[A-Z][a-z]+)+\d*$|^[a-z]\w*\.[a-z]\w*$|^[A-Za-z]+-\d+$", value):
                yield m.start() + at, m.start() + at + len(value), "", "secret in comment"


_PY_TOKEN = re.compile(r"""(?s)\#[^\n]*+|(?<![\w"'])([A-Za-z]{0,2})(?:\"\"\"((?:[^"\\]|\\.|"(?!""))*+)\"\"\"|'''((?:[^'\\]|\\.|'(?!''))*+)'''|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)')""")
_JS_TOKEN = re.compile(r"""(?s)//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/|()(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\]|\\.)*+)`)|(?<=[=(,:\[!&|?{};])\s?/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+""")
# what a literal is bound to, read backwards from it: names of any length, at any distance of blanks and comments
_BOUND = tuple(
    regex.compile(pattern, regex.REVERSE)
    for pattern in (
        r"""(?:getenv|environ\.get|env\.get|config\.get|[gG]etenv|\benv|get_env)\(\s*+["']([\w.\-]+)["']\s*+,\s*+(?:default\s*=\s*)?""",
        r"""(?:process\.env|import\.meta\.env|environ)(?:\.(\w+)|\[\s*["'](\w+)["']\s*\])\s*(?:\|\||\?\?|or)\s*""",
        r"""["'`]([^"'`\n]+)["'`]\s*\]?\s*(?:=|:|=>)\s*[(\[]?\s*[a-zA-Z]{0,2}""",
        r"""(?:set|append|add|put|header|setHeader|set_header|setItem|setdefault|setenv)\(\s*["'`]([^"'`\n]+)["'`]\s*,\s*""",
        r"""(?<![\w$])([\w$]+)\s*[?!]?(?::\s*[\w\[\]|<>., ]+?)?\s*(?:=|:=|===?|:)\s*[(\[]?\s*[a-zA-Z]{0,2}""",
    )
)
_OPENED = regex.compile(r"\[\s*+[a-zA-Z]{0,2}", regex.REVERSE)
_NEXT = re.compile(r"\s*,\s*[a-zA-Z]{0,2}\Z")
_CALLED = regex.compile(r"[\w$.]+", regex.REVERSE)
_ROUND = re.compile(r"[()]")
_LOGIN = re.compile(r"(?i)log_?(?:in|on)|sign_?in|auth|connect|credential|password|secret|bearer|unlock|decrypt|passphrase|api|token|session|client|\buse$|\.use$|basic|ldap|ssh|ftp|smtp|imap|redis|mysql|postgres|mongo")
_NO_LOGIN = re.compile(r"(?i)digest|hash|checksum|integrity|commit|uuid|assert|expect|log(?:ger)?\.(?:info|debug|warn|error)|print|console|load|read|fetch|import|require|regex|compile|t\(|translate|i18n")
_JOIN = re.compile(r"^\s*(?:\+|\.\s*concat\()?\s*(?:\\\s*)?$")


def _string(m: re.Match) -> tuple[str, int, int] | None:
    for g in range(2, (m.re.groups or 1) + 1):
        if m[g] is not None:
            return m[g], m.start(g), m.end(g)
    return None


def _parts(spans: list[tuple[int, int]], start: int, end: int) -> Iterator[tuple[int, int]]:
    """Where characters start to end of joined literals stand."""
    at = 0
    for a, b in spans:
        if at < end and start < at + b - a:
            yield a + max(0, start - at), min(b, a + end - at)
        at += b - a


def _in_embedded(text: str, start: int, end: int, key: str) -> Iterator[Span]:
    """Settings of a configuration that stands in a literal."""
    value = text[start:end]
    if not _SETTING.search(value):
        return
    for keys, inner, a, b in config_formats.nested((key,) if key else (), value, start, prose=True):
        if "\n" not in inner and len(keys) > bool(key) and _by_name(keys, inner, True) and not _REFERENCE.match(inner):
            yield a, b, ".".join(keys), "secret by name"


def _bare(text: str, tokens: list[re.Match]) -> str:
    """``text`` with its comments blanked, at the same places."""
    parts, at = [], 0
    for m in tokens:
        if _string(m) is None and m[0][:1] in ("#", "/") and (m[0][0] == "#" or m[0][:2] in ("//", "/*")):
            parts += (text[at : m.start()], re.sub(r"[^\n]", " ", m[0]))
            at = m.end()
    return "".join([*parts, text[at:]])


def _in_code(text: str, python: bool) -> Iterator[Span]:
    tokens = list((_PY_TOKEN if python else _JS_TOKEN).finditer(text))
    bare = _bare(text, tokens)
    chain: list[tuple[str, int, int]] = []  # literals that are joined
    chain_at = chain_end = 0
    mode = ""
    calls: list[list] = []  # open brackets: place, whether an address of a host stands in them
    call: list | None = None
    breaks = [m.start() for m in re.finditer("\n", text)]
    code_end = 0
    listed, listed_end = "", -1  # name of the list that the literal before stands in, and where that literal ends

    def bound() -> tuple[str, bool]:
        """Name the chain is bound to, and whether by a list."""
        if listed and _NEXT.match(bare, listed_end, chain_at):
            return listed, True
        for pattern in _BOUND:
            if m := pattern.match(bare, 0, chain_at):
                return next(g for g in m.groups() if g), _OPENED.match(bare, 0, chain_at) is not None
        return "", False

    def judge() -> Iterator[Span]:
        nonlocal listed, listed_end
        value = "".join(v for v, _, _ in chain)
        spans = [(a, b) for _, a, b in chain]
        key, in_list = bound()
        listed, listed_end = (key if in_list else ""), chain_end
        if value.startswith("data:"):
            return
        if len(chain) == 1:
            found = list(_by_shape(text, *spans[0], key))
        else:
            found = [(*part, key, "issued token") for a, b, _, _ in _by_shape(value, 0, len(value), key) for part in _parts(spans, a, b)]
        if "\n" in value or "\\n" in value:
            shaped = sorted(found)
            ends = list(accumulate((x[1] for x in shaped), max))
            for a, b in spans:
                for x in [*(_in_comment(text, a, b) if "\n" in value else ()), *_in_embedded(text, a, b, key)]:
                    i = bisect_left(shaped, (x[1],))  # shapes that start before its end
                    if not i or ends[i - 1] <= x[0]:
                        found.append(x)
        yield from found
        if found or "\n" in value:
            return
        level = sensitivity(key) if key else 0
        if level and words(value) == words(key):
            return
        if in_list:
            if level and (random_looking(value) or (level == 2 and secretish(value) and classes(value) == 4)):
                yield from ((a, b, key, "secret by name") for a, b in spans)
            return
        if level and plausible(value, level, key):
            yield from ((a, b, key, "secret by name") for a, b in spans)
        elif not key and len(chain) == 1 and call:
            if _HOST.match(value):
                call[1] = True
            if secretish(value):
                code = chain_at  # end of the code before the literal
                while code and bare[code - 1].isspace():
                    code -= 1
                line = bisect_left(breaks, code)
                name = _CALLED.match(bare, 0, call[0])
                if name and call[0] > (breaks[line - 1] if line else -1) and not _NO_LOGIN.search(name[0]) and (call[1] or _LOGIN.search(name[0])):
                    yield (*spans[0], name[0], "secret in call")

    for m in tokens:
        lit = _string(m)
        for bracket in _ROUND.finditer(bare, code_end, m.start()):
            if bracket[0] == "(":
                calls.append([bracket.start(), False])
            elif calls:
                calls.pop()
        code_end = m.end()
        if lit is None:
            if m[0][:1] in "#/" and m[0][:2] in ("//", "/*") or (python and m[0][0] == "#"):
                if chain:
                    yield from judge()
                    chain = []
                yield from _in_comment(text, m.start(), m.end())
            continue
        between = text[chain_end : m.start()] if chain else ""
        joined = chain and _JOIN.match(between) and ("+" in between or (python and ("\n" not in between or mode == "(")))
        if chain and not joined:
            yield from judge()
            chain = []
        if not chain:
            chain_at, call = m.start(), calls[-1] if calls else None
            mode = "(" if text[max(0, chain_at - 3) : chain_at].rstrip().endswith("(") else ""
        chain.append(lit)
        chain_end = m.end()
    if chain:
        yield from judge()


_CONFIG_COMMENT = re.compile(r"(?m)^[ \t]*[#;](?!!)[^\n]*|[ \t]\#[ \t][^\n]*|^[ \t]*//[^\n]*")


def _by_name(keys: tuple[str, ...], value: str, strict: bool) -> bool:
    """Whether the value of a setting is a secret by its name; ``strict`` asks for the shape of a secret besides. A key that says
    nothing takes the name of the keys around it, if the value looks random."""
    level = sensitivity(keys[-1]) or (1 if len(keys) > 1 and keys[-1].lower() in ("value", "default", "data") and sensitivity(keys[-2]) else 0)
    if not level:
        last = words(keys[-1])
        return bool(last) and last[-1] not in _NEGATIVE and any(sensitivity(k) == 2 for k in keys[:-1]) and random_looking(value)
    return words(value) != words(keys[-1]) and plausible(value, level, keys[-1]) and (not strict or secretish(value))


def _in_settings(text: str, read) -> Iterator[Span]:
    """Credentials of a configuration text: by shape and name in its settings, then by shape in all text that no setting covers."""
    covered: list[tuple[int, int]] = []
    asked = [(s, False, False) for s in (read or config_formats.ini)(text)]
    if read in (None, config_formats.ini):
        asked += [(s, read is None, False) for s in config_formats.bare_rows(text)]
    for (keys, value, start, end), strict, inner in asked:  # grows by nested settings
        covered.append((start, end))
        name = ".".join(keys)
        shaped = list(_by_shape(text, start, end, name))
        yield from shaped
        if "\n" in value or "\\n" in value or '\\"' in value:
            asked += [(s, False, True) for s in config_formats.nested(keys, value, start)]
            if keys and "\n" in value and "-----BEGIN" not in value:  # several values of one name
                asked += [((keys, m[1], start + m.start(1), start + m.end(1)), True, True) for m in re.finditer(r"(?m)^[ \t]*([^\s\\]+)[ \t]*\r?$", value)]
        if keys and not shaped and "\n" not in value and _by_name(keys, value, strict) and not (inner and _REFERENCE.match(value)):
            yield start, end, name, "secret by name"
    covered.sort()
    ends: list[int] = []  # furthest end of all settings up to each
    for _, end in covered:
        ends.append(max(end, ends[-1] if ends else 0))
    for line in re.compile(r"[^\n]+").finditer(text):
        for span in _by_shape(text, line.start(), line.end(), ""):
            i = bisect_left(covered, (span[1], 0))  # settings that start before its end
            if not i or ends[i - 1] <= span[0]:
                yield span
    for m in _CONFIG_COMMENT.finditer(text):
        yield from _in_comment(text, m.start(), m.end())


def find(text: str, path: str | None, language: str | None) -> list[tuple[int, int, str, str]]:
    """Credentials of one text as (start, end, key path, kind), ascending and without overlaps; offsets are in characters."""
    found: list[Span] = []
    for m in _KEY_BLOCK.finditer(text):
        body = re.sub(r"\\[nr]|[\s\"'+,\\]", "", m[1])
        if len(re.sub(r"[^A-Za-z0-9+/=]", "", body)) >= 40 and not re.search(r"\.\.\.|…|\*{4}|x{8}|X{8}|<", body):
            found.append((m.start(1), m.end(1), "", "private key"))
    ext = (path or "").rsplit(".", 1)[-1].lower()
    read = config_formats.reader(path, language)
    if ext in EXTENSIONS or (read is None and (language or "").lower() in ("python", "javascript", "typescript")):
        found.extend(_in_code(text, EXTENSIONS.get(ext, (language or "").lower()) == "python"))
    else:
        found.extend(_in_settings(text, read))
    out: list[Span] = []
    for span in sorted(found, key=lambda s: (s[0], -s[1])):
        if span[0] < span[1] and (not out or span[0] >= out[-1][1]):
            out.append(span)
    return out


def line_of(text: str, start: int, kind: str) -> int:
    """Line (from 1) a credential stands on: that of its first character; of a key block, that of its opening mark."""
    if kind == "private key":
        start = text.rfind("-----BEGIN", 0, start)
    return text.count("\n", 0, start) + 1


_KEY_CHARACTER = re.compile(r"[A-Za-z0-9+/=]")


def redact(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    """``text`` with every character of a credential replaced by ``x``; line breaks, indents and quotes inside key blocks stay."""
    parts, at = [], 0
    for start, end, _, kind in spans:
        parts.append(text[at:start])
        piece = text[start:end]
        if kind == "private key":
            piece = re.sub(r"\\[nr]", "\0\0", piece)
            piece = _KEY_CHARACTER.sub("x", piece)
            source = iter(re.findall(r"\\[nr]", text[start:end]))
            piece = re.sub("\0\0", lambda _: next(source), piece)
        else:
            piece = re.sub(r"[^\r\n]", "x", piece)
        parts.append(piece)
        at = end
    return "".join([*parts, text[at:]])


def _merged(text: str, spans: list[Span]) -> Iterator[tuple[Span, int]]:
    """Spans with their line; joined literals of one credential count at the first line."""
    last_end, last_line, last_key = -1, 0, ""
    for span in spans:
        line = line_of(text, span[0], span[3])
        if span[3] in ("secret by name", "issued token") and span[2] and span[2] == last_key and re.fullmatch(r"[\"'`]\s*\+?\s*[\"'`]", text[last_end : span[0]]):
            line = last_line
        yield span, line
        last_end, last_line, last_key = span[1], line, span[2]


def _locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for id_, repo, path, language, text in zip(batch["id"], batch["repository_id"], batch["file_path"], batch["language"], batch["source"]):
            spans = find(text, path, language)
            ascii_ = text.isascii()
            for (start, end, key, kind), line in _merged(text, spans):
                a = start if ascii_ else len(text[:start].encode())
                rows.append((id_, repo, path, line, key, kind, a, a + (end - start if ascii_ else len(text[start:end].encode()))))
        yield pd.DataFrame(rows, columns=columns)


def _redact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, counts = [], []
        for path, language, text in zip(batch["file_path"], batch["language"], batch["source"]):
            spans = find(text, path, language) if text else []
            texts.append(redact(text, spans) if spans else text)
            counts.append(len(spans))
        yield batch.assign(source=texts, n_redacted=counts)


def credentials(files: DataFrame) -> DataFrame:
    """Credentials of each file: id, repository_id, file_path, line_no (from 1), key_path, kind, byte_start, byte_end (in the
    UTF-8 bytes of source).

    ``files`` needs id, repository_id, file_path, language, source; other columns are ignored. The format is told by the path,
    else by the language; unknown formats are read as lines of settings. Null and empty sources hold none; one row per
    credential and delivered row, a credential of joined literals has a row for each literal, at the line of the first.
    """
    scan = files.where(F.length("source") > 0).select("id", "repository_id", "file_path", "language", "source")
    return spread(scan).mapInPandas(_locate, SCHEMA)


def credential_lines(files: DataFrame) -> DataFrame:
    """id and line_no of each line on which a credential stands, once each; rows without id are left out."""
    return credentials(files).where(F.col("id").isNotNull()).select("id", "line_no").distinct()


def redacted(files: DataFrame) -> DataFrame:
    """id, repository_id, file_path, language, source with every credential blanked out (length and all other characters
    kept), and n_redacted. One row per row of ``files``; null and empty sources stay as they are."""
    scan = files.select("id", "repository_id", "file_path", "language", "source")
    return spread(scan).mapInPandas(_redact, "id string, repository_id string, file_path string, language string, source string, n_redacted int")
