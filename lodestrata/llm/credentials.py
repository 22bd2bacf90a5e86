"""Credentials in literals, configuration and code.

Identifiers and literals are segmented into dictionary words by Viterbi over the words of the corpus's distinct lines. An identifier whose words name a
secret (``smtp_password``, ``webhookSecret``) opens an assignment context; a value in such a context that the dictionary leaves unexplained is a
secret. Known formats of hashes, public keys and certificates, placeholders, format strings and references are excluded; tokens with a public format,
private keys and logins in URLs count in any context. Escapes and split literals are undone before the search, and every finding is mapped back to its
place in the original text, where only the secret's characters are masked.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import ChainMap, Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.batches import chunks
from lodestrata.session import cut

#: Words on at least this share of all word counts form the dictionary, so it can't hold more than 1 / SHARE words.
DICTIONARY_SHARE = 5e-6
#: Residual characters that make a value a secret: beside a name of a secret, and beside a weak name (token, key, auth, login).
STRONG_RESIDUAL, WEAK_RESIDUAL = 1, 8
LEAST_LENGTH = 5

#: Names of secrets, as sequences of words (fixed values, several languages).
STRONG = {
    *"pass password passwd passwort passphrase passcode kennwort secret pwd pw senha contrasena contraseña clave motdepasse mdp пароль haslo hasło heslo parola jelszo jelszó salasana wachtwoord lösenord sifre şifre パスワード 密码 密碼 口令 비밀번호 credential credentials".split(),
    "pass phrase", "pass word", "secret word", "api key", "apikey", "access key", "secret key", "signing key", "private key", "storage key", "account key", "encryption key", "master key", "shared key", "license key", "auth token", "access token", "api token", "bearer token", "refresh token", "client secret", "mot de passe",
}
WEAK = {*"token key auth login bearer authorization credentials".split()}
#: A name that ends with one of these describes a secret and doesn't hold it.
DESCRIBES = {*"length len min max ttl size count id ids name names type kind path file dir url uri host port hint prompt label policy expiry expires expiration timeout age rotation enabled required hash digest checksum sha md5 fingerprint ref field column table index format version reset mask".split()}
HASH_NAMES = re.compile(r"(?i)(?:^|[_\W])(?:md5|sha\d*|sha-\d+|crc\d*|etag|digest|checksum|hash|build.?id|fingerprint|integrity|commit|revision|uuid|guid)(?:$|[_\W])")
PLACEHOLDER = re.compile(r"(?i)(?:[x*.•_#-]+|<[^>]*>?|\$\{.*|\$\(.*|(?-i:\$[A-Z0-9_]+)|%\w*%?|%.*%[sd].*|%[-\d.]*[a-z]{1,3}|\{+[^{}]*\}+|\{+(?:0x\w*|\d*),?|\[[A-Za-z _.-]*\]|@\w+@|change[-_ ]?(?:me|it|this)|null|none|nil|true|false|on|off|yes|no|undefined|n/?a|empty)")
#: Begins a placeholder if a separator or nothing but words follow.
FILL_IN = re.compile(r"(?i)(?:your|my|insert|enter|change|replace|example|dummy|sample|placeholder|redacted|todo|tbd|fixme)")
REFERENCE = re.compile(r"[A-Za-z_]\w*(?:\(|->|\[|\.[A-Za-z_]+(?:\.|\(|\[|$)).*|(?:getenv|env|vault|process|os|config|cfg|self|this)[.:(\[].*")
TOKENS = re.compile(
    r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|xox[abeprs]-[0-9]{5,}-[0-9A-Za-z-]{10,}|gh[opsur]_[0-9A-Za-z]{30,}|glpat-[0-9A-Za-z_-]{20,}|AIza[0-9A-Za-z_-]{30,}|eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}"
    r"|(?:sk|rk|pk)[-_](?:live|test|prod|priv)[-_](?:live[-_]|test[-_]|prod[-_])?[0-9A-Za-z]{16,}|pk_priv[-_](?:live|prod|test)[-_][0-9A-Za-z]{16,}|[a-z]{2,6}_[0-9A-Za-z]{30,}|[0-9a-f]{8}\.[0-9A-Za-z_-]{28,})(?![A-Za-z0-9])"
)
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----([\s\\nr]*(?:[A-Za-z0-9+/=][\s\\]*){24,})")
PUBLIC = re.compile(r"-----BEGIN (?:(?:RSA |EC |DSA )?PUBLIC KEY|CERTIFICATE(?: REQUEST)?|X509 CRL|PGP PUBLIC KEY BLOCK)-----.*?(?:-----END [A-Z0-9 ]+-----|$)", re.DOTALL)
DATA_URI = re.compile(r"data:[\w/+.-]*;base64,[A-Za-z0-9+/=]*")
URL_LOGIN = re.compile(r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{0,30}://([^\s:/@\"'<>]*):([^\s/\"'<>]+)@[\w.\[\]-]+")
ASSIGN = re.compile(r"""(?<![\w$%-])(?P<key>[^\W\d][\w.-]*(?:\[\w*\])?)["']?\s*(?:=>|:=|[=:])\s*(?:(?P<q>["'])(?P<quoted>[^"'\n]*)(?P=q)|(?P<plain>[^\s;&,"'<>][^\s;&"'<>]*))""")
XML = re.compile(r"""\b(?:key|name)=["'](?P<key>[\w.:-]+)["']\s+value=["'](?P<val>[^"']+)["']""")
FLAG = re.compile(r"""(?<!\S)--?(?P<key>[a-zA-Z][\w-]*)[ =]["']?(?P<val>[^\s"']+)""")
HEADER = re.compile(r"""(?i)\b(?P<scheme>bearer|basic|token)\s+(?P<val>[^\s"',;]{8,})""")
LOGIN = re.compile(r"(?i)\b(?:login|user|username|account)\s+\S+\s+(?:pass(?:word|wd|phrase)?|pwd|pw|kennwort|secret)\s+(?P<val>\S+)")
WAS = re.compile(r"(?i)\b(?P<key>(?:pass(?:word|wd|phrase|code)?|pwd|pw|kennwort|secret|token|key))\s+(?:was|is|ist|war|es|era|est|était)\s*:?\s+(?P<val>\S+)")
NOTE = re.compile(r"(?i)(?<!\S)(?P<user>\S{1,200})\s{0,4}/\s{0,4}(?P<val>\S{1,400})\s{0,8}<-+\s*(?:credentials|login|password|account|zugang|pass)\b")
#: Characters given one by one: name[0] = 75; name[1] = 101; or name[] = { 0x4b, 'e', ... }.
STORES = re.compile(r"(?P<key>[^\W\d]\w*)\[(?:0x)?0+\]\s*=\s*(?:0x[0-9a-fA-F]+|\d+|'(?:\\?.)')\s*;(?:\s*(?P=key)\[\w+\]\s*=\s*(?:0x[0-9a-fA-F]+|\d+|'(?:\\?.)')\s*;)+")
STORED = re.compile(r"=\s*(0x[0-9a-fA-F]+|\d+|'(?:\\?.)')")
ARRAY = re.compile(r"(?P<key>[^\W\d]\w*)\s*(?:\[\w*\])?\s*=\s*\{(?P<val>\s*(?:0x[0-9a-fA-F]{1,2}|\d{1,3}|'(?:\\?.)')(?:\s*,\s*(?:0x[0-9a-fA-F]{1,2}|\d{1,3}|'(?:\\?.)'))+)\s*,?\s*\}")
ELEMENT = re.compile(r"0x[0-9a-fA-F]{1,2}|\d{1,3}|'(?:\\?.)'")
#: At least as wide as STORES and ARRAY.
STORING = re.compile(r"\[(?:0x)?0+\]\s*=|=\s*\{")
LITERAL = re.compile(r'"([^"\n]*)"')
ENCODED = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{12,}={0,2}(?![A-Za-z0-9+/=])")
_PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+")
#: Formats of hashes: hexadecimal of the usual lengths, and the prefixed forms of stored password hashes.
HASH_FORMAT = re.compile(r"(?i)[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}")
HASH_KEY = re.compile(r"(?i)(?:cache|hash|lookup|sort|index|map|dedupe|content|primary|foreign|row|object|partition)[_-]?key$")
STORED_HASH = re.compile(r"\$(?:2[abxy]?|1|5|6|7|y|apr1|argon2\w*|scrypt|pbkdf2[\w-]*)\$.+|\{S?SHA\d*\}.+|(?i:(?:md5|sha-?\d+)[:-][0-9a-z+/=]{16,})")
#: Runs of letters beside a digit are parts of ids and secrets.
_WORDS = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2,}+(?!\d)")
_LONGEST_WORD = 24


class Segmenter:
    """Viterbi segmentation into dictionary words; what no word explains costs more per character than any word."""

    def __init__(self, counts: dict[str, int], longest: int = 20):
        named = {w for n in STRONG | WEAK | DESCRIBES for w in n.split()}
        total = sum(counts.values()) + 1
        self.cost = {w: math.log(total) - math.log(n + 1) for w, n in counts.items() if 3 <= len(w) <= longest} | {w: 6.0 for w in named if len(w) > 1}
        self.longest = longest
        self.unknown = max([12.0, *self.cost.values()]) / 2 + 4
        self.memo: dict[str, tuple[tuple[str, ...], int]] = {}

    def with_words(self, extra: dict[str, int]) -> Segmenter:
        """A segmenter that knows a few words more; the dictionary itself isn't copied."""
        out = object.__new__(Segmenter)
        total = math.exp(max(self.unknown * 2 - 8, 1))
        out.cost = ChainMap({w: min(self.unknown * 2 - 8, math.log(total) - math.log(n + 1)) for w, n in extra.items() if 3 <= len(w) <= self.longest}, self.cost)
        out.longest, out.unknown, out.memo = self.longest, self.unknown, {}
        return out

    def unexplained(self, value: str) -> set[str]:
        """Runs of letters in a value, lower-cased, that hold what no word explains."""
        runs = {x.lower() for run in re.findall(r"[^\W\d_]+", value) for x in (run, *_PIECE.findall(run))}
        return {r for r in runs if len(r) >= 3 and self.split(r)[1]}

    def split(self, run: str) -> tuple[tuple[str, ...], int]:
        """(words, unexplained characters) of a run of letters, lower-cased."""
        got = self.memo.get(run)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            if run in self.cost:
                self.memo[run] = (run,), 0
                return self.memo[run]
            best: list[tuple[float, int, bool]] = [(0.0, 0, True)]
            cost, longest, unknown = self.cost, self.longest, self.unknown
            for i in range(1, len(run) + 1):
                b = (best[i - 1][0] + unknown, i - 1, False)
                for j in range(max(0, i - longest), i - 1):
                    c = cost.get(run[j:i])
                    if c is not None and (c := c + best[j][0]) < b[0]:
                        b = (c, j, True)
                best.append(b)
            words, rest, i = [], 0, len(run)
            while i:
                _, j, known = best[i]
                if known:
                    words.append(run[j:i])
                else:
                    rest += i - j
                i = j
            self.memo[run] = got = tuple(reversed(words)), rest
        return got

    def words(self, name: str) -> list[str]:
        """Words of an identifier: by case and separators, then by Viterbi."""
        out: list[str] = []
        for p in _PIECE.findall(name):
            got = self.split(p.lower())
            out += got[0] if got[0] and not got[1] else [p.lower()]
        return out

    def residual(self, value: str) -> int:
        """Characters of a value that no dictionary word explains; separators between words are free."""
        rest = sum(1 for ch in value if not (ch.isalpha() or ch in "-_./ :,"))
        for run in re.findall(r"[^\W\d_]+", value):
            pieces = _PIECE.findall(run)
            one = self.split(run.lower())[1]
            rest += min(one, sum(self.split(p.lower())[1] for p in pieces)) if "".join(pieces) == run else one
        return rest


class View:
    """Text with escapes and split literals undone, and where each character came from."""

    _CODE = re.compile(r'\\x([0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})|\\([0-7]{3})|\\(["\'\\/ntr0])|(?<!\\)"\s*(?:\+|\.\.?|&)\s*"|(?<!\\)\'\s*(?:\+|\.\.?|&)\s*\'|(?<!\\)"\s+"(?=[^,;)]*")')
    _SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}

    def __init__(self, text: str, path_like: bool = False):
        parts, spans, last = [], [], 0
        if "\\" in text or '"' in text or "'" in text:
            for m in self._CODE.finditer(text):
                if path_like and m[4] and m[4] not in "\"'":
                    continue
                if m.start() > last:
                    parts.append(text[last : m.start()])
                    spans.append((last, 1))
                hexa = m[1] or m[2]
                new = chr(int(hexa, 16)) if hexa else chr(int(m[3], 8)) if m[3] else self._SIMPLE.get(m[4], m[4]) if m[4] else ""
                if new:
                    parts.append(new)
                    spans.append((m.start(), m.end() - m.start()))
                last = m.end()
        parts.append(text[last:])
        spans.append((last, 1))
        self.text = "".join(parts)
        self.original = text
        self.starts, at = [], 0
        for p in parts:
            self.starts.append(at)
            at += len(p)
        self.parts, self.spans = parts, spans

    def pieces(self, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, characters) in the original of the view's [a, b)."""
        for p, s, (o, width) in zip(self.parts, self.starts, self.spans, strict=True):
            lo, hi = max(a, s), min(b, s + len(p))
            if lo < hi:
                yield (o, o + width, 1) if width > 1 else (o + lo - s, o + hi - s, hi - lo)


class Finder:
    """Finds the secrets of one text."""

    def __init__(self, words: Segmenter):
        self.words = words
        self.names: dict[str, int] = {}

    def name(self, key: str) -> int:
        """2: names a secret; 1: may name one; 0: neither."""
        got = self.names.get(key)
        if got is None:
            if len(self.names) > 100_000:
                self.names.clear()
            self.names[key] = got = self._name(key)
        return got

    def _name(self, key: str) -> int:
        ws = [w for w in self.words.words(key.rstrip("[]0123456789")) if len(w) > 1]
        if ws and ws[-1] in ("buf", "buffer", "str", "string", "val", "value", "data", "blob", "default"):
            ws.pop()
        if not ws or ws[-1] in DESCRIBES:
            return 0
        tails = {ws[-1], " ".join(ws[-2:]), "".join(ws[-2:]), " ".join(ws[-3:])}
        if tails & STRONG:
            return 2
        return 1 if ws[-1] in WEAK else 0

    def placeholder(self, v: str) -> bool:
        """Whether a value stands for one that is to be filled in, or names a variable."""
        if PLACEHOLDER.fullmatch(v):
            return True
        if re.fullmatch(r"\$[A-Za-z_]+", v):
            return self.words.residual(v[1:]) < 4  # short parts of names, as in $db_pass, are no words
        if m := FILL_IN.match(v):
            rest = re.sub(r"[-_]?(?:0+|1|12|123\d*)$", "", v[m.end() :])
            return not rest or not self.words.residual(rest) or rest[0] in "-_ ." and all(c.isalpha() or c in "-_ .:!?" for c in rest)
        return False

    def value(self, v: str, strength: int, blanks: bool = False, name: str = "") -> bool:
        """Whether a value beside a name of this strength is a secret; ``blanks``: it is quoted and may hold blanks. Beside ``cache_key`` and the like what
        has the format of a hash is one; tokens often have it as well."""
        if len(v) < LEAST_LENGTH or not v.isprintable() or self.placeholder(v) or REFERENCE.fullmatch(v) or re.search(r"%[-\d.]*(?:l*[sdxu])|\$\{|\{\{|\*{3}|[xX]{4}|://", v) or re.search(r"^\s|\s$|[:?.…]$" if blanks and strength == 2 and " " in v else r"\s", v):
            return False
        if v.isdigit() and len(v) < 12 and strength < 2 or re.fullmatch(r"0x[0-9a-fA-F]+", v):
            return False
        if STORED_HASH.fullmatch(v) or strength < 2 and HASH_KEY.search(name) and HASH_FORMAT.fullmatch(v) or any(c >= "\u2e80" for c in v):
            return False  # a hash; or text of a script that isn't typed as a password
        rest = self.words.residual(v)
        if strength == 2:
            return rest >= STRONG_RESIDUAL
        return rest >= WEAK_RESIDUAL and sum(c.isdigit() for c in v) >= 2 and not (v.startswith("/") or "\\" in v)

    def basic(self, v: str) -> bool:
        """Base64 of login and password."""
        try:
            raw = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8")
        except (binascii.Error, ValueError):
            return False
        user, colon, word = raw.partition(":")
        return bool(user and colon and raw.isprintable() and len(word) >= 3 and not self.placeholder(word) and not re.search(r"%[sd]|\$\{|\s", raw))

    def spans(self, view: View) -> list[tuple[int, int]]:
        """[start, end) of the secrets in the view."""
        t = view.text
        out: list[tuple[int, int]] = []
        shut = [m.span() for m in PUBLIC.finditer(t)] + [m.span() for m in DATA_URI.finditer(t)] if "-----BEGIN" in t or "base64," in t else []
        free = lambda a: not any(x <= a < y for x, y in shut)
        if "PRIVATE KEY" in t:
            out += [m.span(1) for m in PRIVATE.finditer(t)]
        for m in TOKENS.finditer(t):
            v = m[0]
            before = t[max(0, m.start() - 24) : m.start()]
            if free(m.start()) and "EXAMPLE" not in v.upper() and not self.placeholder(v) and not re.search(r"[xX*]{5}", v) and not HASH_NAMES.search(before) and self.words.residual(v) >= WEAK_RESIDUAL:
                out.append(m.span())
        if "://" in t and "@" in t:
            for m in URL_LOGIN.finditer(t):
                if not self.placeholder(m[2]) and not re.search(r"%[sd]|\$\{|\{\{|^[*xX]+$", m[2]) and m[2].lower() not in ("password", "pass", "secret", "pw"):
                    out.append(m.span(2))
        at = 0
        lines = t.split("\n")
        for i, line in enumerate(lines):
            # A value may stand on the line after its name.
            both = f"{line}\n{lines[i + 1]}" if i + 1 < len(lines) and line.rstrip()[-1:] in ("=", ":") else line
            out += [(at + x, at + y) for x, y in self.named(both) if free(at + x)]
            at += len(line) + 1
        if STORING.search(t):
            out += self.stored(t)
        for m in ENCODED.finditer(t):  # whole logins or settings in base64
            if free(m.start()) and len(m[0]) >= 16 and not any(x <= m.start() and m.end() <= y for x, y in out):
                try:
                    raw = base64.b64decode(m[0] + "=" * (-len(m[0]) % 4), validate=True).decode("ascii")
                except (binascii.Error, ValueError):
                    continue
                if raw.isprintable() and ASSIGN.search(raw) and self.spans(View(raw, path_like=True)):
                    met = [s for s in out if s[0] < m.end() and m.start() < s[1]]
                    out = [s for s in out if s not in met] + [(min([m.start(), *(x for x, _ in met)]), max([m.end(), *(y for _, y in met)]))]
        return out

    def named(self, t: str) -> list[tuple[int, int]]:
        """Secrets beside their names in a line."""
        out: list[tuple[int, int]] = []
        at = 0
        while m := ASSIGN.search(t, at):
            g = "quoted" if m["q"] else "plain"
            at = m.start(g)  # what looks like a value may hold an assignment itself, as the address in url = https://...?token=...
            s = self.name(m["key"].rsplit(".", 1)[-1])
            if s:
                v = m[g].rstrip(",)]}") if g == "plain" else m[g]
                if not re.match(r"(?i)(?:bearer|basic|token)(?:\s|$)", v) and not (g == "plain" and PLACEHOLDER.fullmatch(m[g].rstrip(",)"))) and self.value(v, s, g == "quoted", m["key"]):
                    out.append((at, at + len(v)))
                    at += len(v)
        for pattern in (XML, FLAG):
            for m in pattern.finditer(t):
                if (s := self.name(m["key"])) and self.value(m["val"], s, name=m["key"]):
                    out.append(m.span("val"))
        for m in HEADER.finditer(t):
            near = re.search(r"(?i)authorization|header|auth", t[max(0, m.start() - 40) : m.start()])
            v = m["val"]
            if m["scheme"].lower() == "basic":
                if self.basic(v):
                    out.append(m.span("val"))
            elif near and not self.placeholder(v) and self.value(v, 1):
                out.append(m.span("val"))
        for pattern in (LOGIN, NOTE) if "<-" in t else (LOGIN,):
            for m in pattern.finditer(t):
                if self.value(m["val"], 2):
                    out.append(m.span("val"))
        for m in WAS.finditer(t):
            v = m["val"].rstrip(".,;")
            if self.value(v, self.name(m["key"]) or 1):
                out.append((m.start("val"), m.start("val") + len(v)))
        if '"' in t:
            outside = LITERAL.sub(" ", t)
            literals = list(LITERAL.finditer(t))
            s = max((self.name(w) for w in re.findall(r"[^\W\d]\w*", outside)), default=0)
            if s < 2 and len(literals) > 1:  # setenv("X_SECRET", "..."): the name is a literal of its own
                s = max([s, *(self.name(m[1]) for m in literals if re.fullmatch(r"[A-Za-z][\w-]*", m[1]))])
            if s == 1 and re.search(r"//.*\b(?:login|pass|credentials)\b", outside):
                s = 2
            if s and not HASH_NAMES.search(outside):
                for m in literals:
                    if "-----BEGIN" not in m[1] and self.value(m[1], s, name=outside.rstrip(" =:;,(")) and not self.name(m[1]) and "=" not in m[1][:-2] and not re.search(r'["{}]', m[1]):
                        out.append(m.span(1))
        return out

    def stored(self, t: str) -> list[tuple[int, int]]:
        """Secrets written character by character; the spans cover each character's number."""
        out = []
        for pattern, element, group in ((STORES, STORED, 0), (ARRAY, ELEMENT, "val")):
            for m in pattern.finditer(t):
                s = self.name(m["key"])
                if not s:
                    continue
                parts = [(x.start(x.re.groups), x[x.re.groups]) for x in element.finditer(t, m.start(group), m.end(group))]
                codes = [ord(x[-2]) if x[0] == "'" else int(x, 16 if x.startswith("0x") else 8 if re.fullmatch("0[0-7]+", x) else 10) for _, x in parts]
                while codes and not codes[-1]:
                    codes.pop()
                if all(32 <= c < 127 for c in codes) and self.value("".join(map(chr, codes)), s):
                    out += [(a + 1, a + len(x) - 1) if x[0] == "'" else (a + 2 * x.startswith("0x"), a + len(x)) for a, x in parts[: len(codes)]]
        return out

    def find(self, text: str) -> tuple[View, list[tuple[int, int]]] | None:
        view = View(text, path_like=bool(re.match(r"[A-Za-z]:\\|Software\\", text)))
        spans = self.spans(view)
        return (view, spans) if spans else None

    @staticmethod
    def mask(view: View, spans: list[tuple[int, int]], sign: str = "*") -> str:
        """The original with one sign for each character of a secret; quotes, line breaks and everything else stay."""
        text, cuts = view.original, sorted({p for a, b in spans for p in view.pieces(a, b)})
        out, last = [], 0
        for a, b, n in cuts:
            if b <= last:
                continue
            a = max(a, last)
            piece = text[a:b]
            out.append(text[last:a])
            keep = piece in ("\\n", "\\r")
            if re.fullmatch("[0-9a-fA-F]{1,3}", piece) and re.search(r"(?:[=,{]\s*|0x)$", text[max(0, a - 4) : a]) and re.match(r"\s*[;,}]", text[b : b + 4]):
                out.append("0" * len(piece))  # a character given by its number stays a number
                last = b
                continue
            out.append(piece if keep else sign if b - a > n else "".join(c if c in "\r\n" else sign for c in piece))
            last = b
        return "".join(out) + text[last:]


def word_counts(texts: DataFrame) -> DataFrame:
    """w, n: words of ``text`` in at least three distinct lines of the whole corpus.

    A word counts once per distinct line, so that a secret in copies or near copies of a text doesn't become a word. Distinct lines are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["w", "n"])
            counts.clear()
            return b

        for _, part in chunks(batches):
            for t in part:
                counts.update({p.lower() for w in _WORDS.findall(t) for p in _PIECE.findall(w) if 2 < len(p) <= _LONGEST_WORD})
            if len(counts) > 200_000:
                yield flush()
        if counts:
            yield flush()

    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).select(F.trim("line").alias("text")).where(F.col("text").rlike("[A-Za-z]{3}")).distinct()
    return lines.mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).where("n >= 3")


def _extra_words(found: DataFrame, tail: DataFrame) -> DataFrame:
    """at, words: rarer words inside the unexplained runs of each finding. Parts of the runs are joined with the words, of which no part is broadcast."""
    runs = found.select(F.explode("runs").alias("run")).distinct()
    length = F.length("run")
    part = F.flatten(F.transform(F.sequence(F.lit(3), F.least(length, F.lit(_LONGEST_WORD))), lambda n: F.transform(F.sequence(F.lit(1), length - n + 1), lambda i: F.substring(F.col("run"), i, n))))
    known = runs.select("run", F.explode(F.array_distinct(part)).alias("w")).join(tail, "w").groupBy("run").agg(F.collect_list(F.struct("w", "n")).alias("ws"))
    return found.select("at", F.explode("runs").alias("run")).distinct().join(known, "run").groupBy("at").agg(F.array_distinct(F.flatten(F.collect_list("ws"))).alias("words"))


_FOUND = "rec_table string, rec_id bigint, secrets int, text string"


def secrets(texts: DataFrame, counts: dict[str, int] | None = None, share: float = DICTIONARY_SHARE) -> DataFrame:
    """rec_table, rec_id, secrets (their number) and masked text of each text that holds a secret.

    ``texts`` has rec_table, rec_id and text. Null and empty texts hold none; repeated rows give repeated rows; other columns are ignored; an empty
    table gives none. Whole texts are searched; texts are read twice (dictionary, search); the dictionary shuffles their distinct lines.

    Words on at least ``share`` of all counts are broadcast, 1 / share at most. What they leave unexplained in a finding is joined with all rarer
    words, and the few texts whose findings hold such words are searched again with them, so no word is left out at any size.
    """
    tail = None
    if counts is None:
        words = cut(word_counts(texts))
        least = (words.agg(F.sum("n")).first()[0] or 0) * share
        counts = {r.w: r.n for r in words.where(F.col("n") >= least).toLocalIterator()}
        tail = words.where(F.col("n") < least)
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(Segmenter(shared.value))
        for rows, part in chunks(batches):
            where, n, masked, runs = [], [], [], []
            for i, t in enumerate(part):
                if t and (got := finder.find(t)):
                    view, spans = got
                    where.append(i)
                    n.append(len(set(spans)))
                    masked.append(finder.mask(view, spans))
                    runs.append(sorted({r for a, b in spans for r in finder.words.unexplained(view.text[a:b])}))
            if where:
                at = pa.array(where)
                yield pa.RecordBatch.from_arrays([rows.column("rec_table").take(at), rows.column("rec_id").take(at), pa.array(n, pa.int32()), pa.array(masked, pa.string()), rows.column("text").take(at), pa.array(runs, pa.list_(pa.string()))], names=["rec_table", "rec_id", "secrets", "masked", "text", "runs"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = Segmenter(shared.value)
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["words"]:
                    finder = Finder(base.with_words({x["w"]: x["n"] for x in row["words"]}))
                    got = finder.find(row["text"])
                    if got:
                        out.append((row["rec_table"], row["rec_id"], len(set(got[1])), finder.mask(*got)))
                else:
                    out.append((row["rec_table"], row["rec_id"], row["secrets"], row["masked"]))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=["rec_table", "rec_id", "secrets", "text"])

    found = texts.select("rec_table", F.col("rec_id").cast("bigint").alias("rec_id"), "text").where("text is not null and text <> ''").mapInArrow(search, "rec_table string, rec_id bigint, secrets int, masked string, text string, runs array<string>")
    if tail is None:
        return found.select("rec_table", "rec_id", "secrets", F.col("masked").alias("text"))
    found = cut(found.withColumn("at", F.md5("text")))
    return found.join(_extra_words(found, tail), "at", "left").mapInArrow(again, _FOUND)
