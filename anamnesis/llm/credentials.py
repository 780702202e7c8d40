"""Credentials in source code, configuration, tool traffic and prompts: found, scored, and masked in place.

Every text yields candidate values: what follows a name and a sign of assignment, quoted strings, user info of URLs,
long mixed strings, values near a word for a secret, and bodies of private keys. A candidate is described by the
likelihood of its characters under a Markov chain of ordinary words and names, its shape, the identifiers and words
around it, and the file it stands in. A logistic regression, fitted on candidates that patterns label for sure either
way, scores all candidates; its scores are calibrated against held-out labels, and what reaches THRESHOLD is masked.
The patterns only label: no verdict of theirs is a feature or overrules a score. Plain words, names, paths and numbers
are candidates where a name or sentence hands them over as a secret.

Chain, regression and calibration are fitted on all texts. The texts are read once: their words, and the candidates with
their features, are stored, words are counted by a shuffle, and each step of the fit (L-BFGS) is a sum over all labelled
candidates, made of whole numbers, so that the weights depend neither on partitions nor on their order. The driver holds
sums of fixed size only. Equal texts of a batch are described once.

Defined results: null texts have no credentials; a masked text differs from the given one only inside the secrets, each
of which becomes MASK; rows without id are left out; several rows of one id are reported once per field.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.marks import dense
from anamnesis.plans.scratch import cores, shuffles_dropped, spread, written

MASK = "[REDACTED_SECRET]"
BITS = 15  #: hashed features
RIDGE, STEPS, KEPT = 3.0, 60, 10  #: of the fit: what large weights cost, steps at most, and steps that shape the next one
WHOLE = 1 << 20  #: sums over candidates are made in whole numbers of this part of one
BINS = 64  #: of a raw score, for the calibration
THRESHOLD = 0.5

# Words for secrets, words for harmless identifiers, and public formats of keys.
SECRET = r"pass(?:word|wd|phrase|code)?s?|pwd|pw|passwort|kennwort|contraseña|mot de passe|clave|secrets?|tokens?|api[_-]?keys?|apikey|credentials?|auth(?:token)?|authorization|bearer|(?:private|signing|encryption|master|account|access|shared|client)[_ -]?(?:keys?|secret)|login|sshpass|sudo"
KNOWN = r"(?:sk|pk|rk)_live_[0-9a-zA-Z]{16,}|sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{15,}|npm_[A-Za-z0-9]{20,}|xox[abprs]-[\w-]{10,}|AIza[\w-]{30,}|hf_[A-Za-z0-9]{20,}|dop_v1_\w{20,}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,}|pypi-[\w-]{20,}|shp(?:at|ss)_[0-9a-f]{20,}"
HARMLESS = r"sha\d*|md5|checksum|hash|integrity|etag|commit|parent|revision|uuid|guid|id|image|fingerprint|ssh-(?:rsa|ed25519|dss)|public|certificate|version|trace|span|nonce|max_tokens|token_count|data:image"
REFERENCE = re.compile(r"^(?:\$|\$\{|\{\{|<|%\w+%|%\(|\*{3,}|x{4,}$|\.{3}|…|\[?REDACTED|process\.env|os\.environ|env\[|ENV\[|vault|getenv|secrets\.|config\.|settings\.)|[<>{}]|\$\{|\*{4,}|•{3,}|_?(?:here|goes)_?-?>?$", re.I)
PLACEHOLDER = re.compile(r"(?<![a-z0-9])(?:your|my|paste|insert|replace|change(?:me)?|example|dummy|placeholder|redacted|sample|todo|fixme|none|null|undefined|true|false|x{4,})(?![a-z0-9])", re.I)

#: what stands for a secret that is kept elsewhere
INSTEAD = ("process.env.NAME", "settings.key", "${NAME}", "config.value", "<your-key>", "changeme", "********", "os.environ", "secrets.NAME", "your_key_here")

BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*?)-----")
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<v>.*?)(?:-----END [A-Z0-9 ]*-----|\Z)", re.S)
PUBLIC = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE(?: REQUEST)?)-----.*?(?:-----END [A-Z0-9 ]*-----|\Z)", re.S)
PICTURE = re.compile(r"data:[\w/+.-]+;base64,[A-Za-z0-9+/=]+")
VALUE = r"[^\s\"'`,;(){}<>\[\]|\\]{6,}"
FORMS = re.compile(
    rf"""(?P<known>(?<![\w-])(?:{KNOWN})(?![\w]))
    |://[^/\s:@"'<>]*:(?P<url>[^@\s/"'<>]{{3,}})@
    |[?&](?i:access_token|auth|token|sig|signature|api_?key|key|secret|password)=(?P<query>[^&\s"'<>#\\]{{6,}})
    |\b(?i:basic|bearer)[^\S\n]+(?P<auth>[\w.+/=~-]{{8,}})
    |(?<![\w/])[\w.-]+:\d{{2,5}}:[\w*.-]+:[\w.-]+:(?P<pgpass>[^\s:"'\\]{{4,}})
    |(?P<quote>["'`])(?P<quoted>[^\s"'`\\:=]{{6,}}={{0,2}})(?P=quote)
    |[=:][^\S\n]?(?!//|(?i:basic|bearer)\s)(?P<given>{VALUE})
    |(?<![\w/.@$-])(?P<bare>[A-Za-z0-9][\w+/=.~!?@#$%^&*-]{{7,}})""",
    re.X,
)
WORDS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zß-ÿ]+|\d+")
SECRET_RE = re.compile(rf"(?<![a-z])(?:{SECRET})(?![a-z])", re.I)
KNOWN_HEAD = re.compile(KNOWN)
KNOWN_RE = re.compile(rf"(?:{KNOWN})$")
HARMLESS_RE = re.compile(rf"(?<![a-z])(?:{HARMLESS})(?![a-z])", re.I)
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)
NAME_LIKE = re.compile(r"(?:\d+:)?[A-Za-z]*(?:[a-z_]\d{0,3}[_.-][A-Za-z]+)*\d{0,3}(?:[:/.-]\d{1,3})?$")
PHRASE = re.compile(r"(?:[a-z][a-z4301]{2,}[-_!%#.&+]){0,4}[a-z][a-z4301]{2,}[-_]?\d{4,5}[!?#$%&*_]?$", re.I)
#: two or more words and some digits: a phrase for a secret only where its name says so
LOOSE = re.compile(r"(?:[a-z][a-z4301]{2,}[-_!%#.&+]){1,4}[a-z][a-z4301]{2,}[-_]?\d{1,6}[!?#$%&*_]?$", re.I)
STRONG = re.compile(r"(?:pass(?:word|wd|phrase|code)?|pwd|_pw|passwort|kennwort|contraseña|secret|api[_-]?key|(?:^|[A-Z]_)TOKEN)$|^(?:api|access|auth|secret)[_-]?token$")
#: each alternative of SECRET holds one of these
HINTS = ("pass", "pw", "kennwort", "contrase", "clave", "secret", "token", "key", "credential", "auth", "bearer", "login", "sudo")
#: a sentence that hands over a value in no quotes
SAYS = re.compile(rf"(?<![a-z])(?:(?:{SECRET})(?![a-z])[^.;\n=:\"'`]{{0,40}}?\b(?:is|es|est|ist|lautet)|password)[ \t]+(?P<v>{VALUE})", re.I)


def is_path(v: str) -> bool:
    return "/" in v and all(NAME_LIKE.match(x) or x in (".", "..", "~", "*") for x in re.split(r"/|:(?=\d)", v.removeprefix("@")))


def ordinary(v: str) -> bool:
    """Plain names, paths and numbers: nothing random in them."""
    return v.isascii() and v.isalpha() or bool(NAME_LIKE.match(v)) or is_path(v) or v.isdigit()


def scrambled(v: str) -> bool:
    """Letters of both cases that change too often to be words, with or without digits."""
    pieces = SPLIT.findall(v)
    return len(v) >= 8 and len(pieces) >= 4 and len(v) <= 4 * len(pieces) and bool(re.search("[a-z]", v)) and bool(re.search("[A-Z]", v))


@dataclass
class Candidate:
    start: int
    end: int
    value: str
    form: str
    before: str  # up to 90 characters of the text on its left, and 60 on its right
    after: str
    features: list[int] = field(default_factory=list)
    name: str | None = None  # of named(), once asked for


def shadow(text: str) -> str:
    """The text with escaped line ends, tabs and quotes replaced, at the same length."""
    return text.replace("\\\\n", "  \n").replace("\\n", " \n").replace("\\t", " \t").replace('\\"', ' "').replace("\\\\", "  ")


def candidates(text: str) -> list[Candidate]:
    s = shadow(text)
    out: list[Candidate] = []
    blank = lambda m: " " * len(m[0])
    if "-----BEGIN" in s:
        for m in PRIVATE.finditer(s):
            body = m["v"].strip()
            if len(re.sub(r"[^A-Za-z0-9+/=]", "", body)) >= 32 and "REDACTED" not in body and "..." not in body:
                lo, hi = m.start("v") + len(m["v"]) - len(m["v"].lstrip()), m.start("v") + len(m["v"].rstrip())
                out.append(Candidate(lo, hi, s[lo:hi], "pem", s[max(0, m.start() - 60) : lo], s[hi : hi + 40]))
        s = PUBLIC.sub(blank, PRIVATE.sub(blank, s))
    if ";base64," in s:
        s = PICTURE.sub(blank, s)
    some = hinted(s)
    for m in FORMS.finditer(s):  # no form goes over the end of a line
        form = m.lastgroup
        lo, hi = m.span(form)
        v = m[form].rstrip(".,:;")
        if v.endswith("?") and form in ("bare", "given") and not PHRASE.search(m[form]):
            v = v.rstrip(".,:;?")
        if form in ("given", "quoted", "bare") and "=" in v and re.match(r"[\w.-]+=", v) and not v.endswith("="):
            lo += v.index("=") + 1
            v = v[v.index("=") + 1 :]
        plain = form in ("given", "quoted", "bare") and ordinary(v)
        if KNOWN_RE.match(v):
            form, plain = "known", False
        if plain and not (some and hinted(s[s.rfind("\n", 0, lo) + 1 : (s.find("\n", lo) + 1 or len(s) + 1) - 1])):
            continue
        if len(v) >= 4 and "://" not in v and s[lo + len(v) : lo + len(v) + 1] != "(":
            c = Candidate(lo, lo + len(v), v, form, s[max(0, lo - 90) : lo], s[lo + len(v) : lo + len(v) + 60])
            if not plain or handed(c):
                out.append(c)
    for m in SAYS.finditer(s) if some else ():  # words that no form above takes for a value, or not from their first character
        v = m["v"].rstrip(".:?")
        lo, hi = m.start("v"), m.start("v") + len(v)
        if len(v) >= 6 and "://" not in v and s[hi : hi + 1] != "(" and all(c.end <= lo or hi <= c.start or c.form == "bare" and lo < c.start and c.end <= hi for c in out):
            out = [c for c in out if c.end <= lo or hi <= c.start]
            out.append(Candidate(lo, hi, v, "bare", s[max(0, lo - 90) : lo], s[hi : hi + 60]))
    return out


def entropy(v: str) -> float:
    n = len(v)
    return -sum(c / n * math.log2(c / n) for c in Counter(v).values())


class Chain:
    """Markov chain over characters: log-likelihood of a string as an ordinary word or name, per character."""

    ALPHABET = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789_-./+=")}

    SIZE = len(ALPHABET) + 1
    CODES = np.zeros(128, np.int64)  #: by ASCII code
    CODES[[*map(ord, ALPHABET)]] = [*ALPHABET.values()]

    def __init__(self, counts: np.ndarray):
        n = 1.0 + counts.reshape((self.SIZE,) * 3)
        self.table = np.log(n / n.sum(2, keepdims=True))

    @classmethod
    def counts(cls, words: list[str], n: Iterable[int]) -> np.ndarray:
        """How often each three characters follow each other in different words that occur so often; a word counts for 50 at most."""
        if not words:
            return np.zeros(cls.SIZE**3, np.int64)
        low = [w.lower() for w in words]
        x = np.frombuffer("".join(f"\0\0{w}\0" for w in low).encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.where(x < 128, cls.CODES[np.minimum(x, 127)], 0)
        size = np.fromiter(map(len, low), np.int64, len(low)) + 3
        inside = np.ones(len(x), bool)
        inside[np.cumsum(size) - 1] = inside[np.cumsum(size) - 2] = False
        at = np.flatnonzero(inside)
        weights = np.repeat(np.minimum(np.fromiter(n, np.int64, len(low)), 50), size - 2)
        return np.bincount((x[at] * cls.SIZE + x[at + 1]) * cls.SIZE + x[at + 2], weights, cls.SIZE**3).astype(np.int64)

    def score(self, v: str) -> float:
        x = [0, 0, *(self.ALPHABET.get(ch, 0) for ch in v.lower()), 0]
        return float(self.table[x[:-2], x[1:-1], x[2:]].mean()) if v else 0.0


#: a sentence or command that hands a secret over
SAID = re.compile(rf"(?:(?<![a-z])(?:{SECRET})(?![a-z])[^.;\n]{{0,40}}(?:\b(?:is|es|est|ist|lautet|password)|[:=/]|-p)\s*[\"'`]?|\b(?:4\d\d with \w+:|sshpass -p\s*[\"']?|identified by\s*[\"']?|log in as \w+ / ?))$", re.I)


def line_of(c: Candidate) -> tuple[str, str]:
    return c.before.rpartition("\n")[2], c.after.partition("\n")[0]


def named(c: Candidate) -> str:
    """The identifier a value is given to, or nothing."""
    if c.name is not None:
        return c.name
    left = re.sub(r"[\"'][^\"'\s]*\s*[\"']\s*\+\s*[\"']?$", "", line_of(c)[0])  # the first part of a sum of strings
    m = re.search(r"([A-Za-z_@/][\w.@/-]*)[\"'\])]*(?:\s*:\s*[\w\[\]<>; ]+?)?\s*(?:=|:|=>|:=|\s)\s*(?:[\w.!]+\()?\s*[\"'`]?(?:(?:basic|bearer)\s+)?$", left, re.I)
    c.name = m[1] if m else ""
    return c.name


def secret_named(name: str) -> bool:
    return bool(word_for_secret(" ".join(SPLIT.findall(name)) + " " + name) or re.search(r"(?:password|passwd|passphrase|secret|token|api[_-]?key|_pw)$", name, re.I))


def hinted(s: str) -> bool:
    s = s.lower()
    for h in HINTS:
        if h in s:
            return True
    return False


def word_for_secret(s: str) -> bool:
    return hinted(s) and bool(SECRET_RE.search(s))


def said(left: str) -> bool:
    """A sentence or command hands the value over, and it is not assigned to another name."""
    return bool(SAID.search(left)) and not re.search(r"(?<!\bis)(?<!\bes)(?<!est)(?<!ist)(?<!lautet)\s*[=:]\s*[\"'`]?$", left, re.I)


def handed(c: Candidate) -> bool:
    """The value is given to a name for secrets, or a sentence hands it over as one."""
    left = line_of(c)[0]
    return hinted(left) and (secret_named(named(c)) or said(left))


def strong(c: Candidate, name: str) -> bool:
    """The name, or the sentence, says that the value itself is a secret."""
    return bool(STRONG.search(name) or STRONG.search(name.lower())) or (said(line_of(c)[0]) and not secret_named(name))


def label(c: Candidate) -> int | None:
    """1 or 0 where a pattern is sure, else None."""
    v, (left, right) = c.value, line_of(c)
    if c.form == "pem":
        return 1
    if REFERENCE.search(v) or (PLACEHOLDER.search(v) and not re.search(r"\d{3}", v)):
        return 0
    if c.form == "known":
        return 0 if re.match(r"pk_", v) else 1
    if c.form == "url" and re.search(r"\d|[A-Z]", v):
        return 1
    if UUID.match(v) or re.match(r"sha\d+[-:]", v):
        return 0
    name = named(c)
    near = left[-40:]
    if HARMLESS_RE.search(" ".join(SPLIT.findall(name))) and not secret_named(name):
        return 0
    sure = strong(c, name)
    if sure and (scrambled(v) or LOOSE.match(v)):
        return 1
    if sure and (ordinary(v) or not re.search(r"\d", v)):
        return 0 if v.isalpha() and len(v) <= 12 and len(SPLIT.findall(v)) < 3 else None
    random_ = len(v) >= 12 and entropy(v) >= 3.0 and bool(re.search(r"\d", v)) and bool(re.search(r"[A-Za-z]", v)) and not ordinary(v)
    secretish = random_ or bool(PHRASE.match(v))
    if c.form == "pgpass" and secretish:
        return 1
    if c.form == "auth":
        return 1 if secretish or len(v) > 20 else 0
    if secretish and re.search(r"\b(?:AKIA|ASIA)[A-Z0-9]{12,}", v):
        return 0
    if secretish and secret_named(name):
        return 1
    if secretish and re.match(r"value$", name, re.I) and word_for_secret(" ".join(SPLIT.findall(near))):
        return 1
    if secretish and c.form == "query":
        return 1
    if secretish and word_for_secret(right[:45]) and (c.form in ("quoted", "given") or left[-1:] in "\"'") and not HARMLESS_RE.search(near):
        return 1
    if secretish and SAID.search(left):
        return 1
    if secretish and word_for_secret(near):
        return None
    if ordinary(v) or not re.search(r"\d", v):
        return 0
    if not word_for_secret(c.before[-90:] + " " + right):
        return 0
    return None


@lru_cache(1 << 16)
def _h(s: str) -> int:
    return zlib.crc32(s.encode()) & ((1 << BITS) - 1)


def described(c: Candidate, chain: Chain, file: str) -> list[int]:
    """Hashed features of a candidate."""
    return completed(*before_chain(c, file), chain.score(c.value))


def completed(features: list[int], tail: str, ll: float) -> list[int]:
    """The features of before_chain with those that the chain's score makes."""
    return sorted({*features, _h(f"ll{int(ll * 2)}"), _h(f"ll{int(ll * 2)}-{tail}")})


def before_chain(c: Candidate, file: str) -> tuple[list[int], str]:
    """The features of a candidate that need no chain, and what its score is looked at together with."""
    v, (left, right) = c.value, line_of(c)
    e, n = entropy(v), len(v)
    kinds = (bool(re.search(r"\d", v)), bool(re.search(r"[a-z]", v)), bool(re.search(r"[A-Z]", v)), bool(re.search(r"[^\w]", v)))
    shape = "hex" if re.match(r"[0-9a-f]+$", v) else "uuid" if UUID.match(v) else "phrase" if PHRASE.match(v) else "scrambled" if scrambled(v) else "loose" if LOOSE.match(v) else "path" if is_path(v) else "name" if NAME_LIKE.match(v) else "mixed"
    ref = "ref" if REFERENCE.search(v) else "hole" if PLACEHOLDER.search(v) else "lit"
    name = named(c)
    parts = [p.lower() for p in SPLIT.findall(name)]
    lefts = [w.lower() if not w.isdigit() else "0" for w in WORDS.findall(left[-60:])[-5:]]
    rights = [w.lower() if not w.isdigit() else "0" for w in WORDS.findall(right[:45])[:5]]
    secret, harmless = secret_named(name), bool(HARMLESS_RE.search(" ".join(parts)))
    near, further = word_for_secret(" ".join(SPLIT.findall(left[-60:]))), word_for_secret(c.before + " " + right)
    f = [
        "bias", f"e{int(e * 2)}", f"n{min(n // 4, 12)}", f"k{kinds}", f"shape-{shape}", f"form-{c.form}", f"ref-{ref}", f"ref-{ref}-{secret}", f"ref-{ref}-{near}-{c.form}",
        f"{shape}-{ref}-{c.form}", f"{shape}-{secret}-{harmless}", f"{shape}-strong-{strong(c, name)}", f"{shape}-{near}-{further}-{ref}", f"e{int(e)}-{secret}-{near}-{ref}",
        f"file-{file}", f"file-{file}-{shape}", f"known-{bool(KNOWN_HEAD.match(v))}", f"head-{v[:4]}" if n > 8 else "short",
    ]
    f += [f"name-{p}" for p in parts[-3:]] + [f"l-{w}" for w in lefts] + [f"r-{w}" for w in rights]
    f += [f"l{i}-{w}" for i, w in enumerate(lefts[::-1][:3])] + [f"name-{p}-{shape}" for p in parts[-1:]]
    return sorted({_h(x) for x in f}), f"{secret}-{near}"


def file_of(text: str, tool: str | None) -> str:
    """Kind of file a text belongs to: the ending of the path named at its start, else the tool."""
    m = re.search(r'"(?:file_)?path"\s*:\s*"[^"]*?(?:\.(\w{1,6})|/([\w.-]+))"', text[:400])
    return (m[1] or m[2] or "?").lower() if m else (tool or "?").lower()


@dataclass
class Model:
    chain: Chain
    weights: np.ndarray
    scale: tuple[float, float]  # calibration of the raw score
    held_out: dict[str, float]

    def probability(self, c: Candidate, file: str) -> float:
        z = float(self.weights[described(c, self.chain, file)].sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.scale[0] * z + self.scale[1]))))


WORD, LONG, MIXED = re.compile(r"[A-Za-z][\w.-]{2,}"), re.compile(r"\S{30,}"), re.compile(r"\d.*[A-Za-z].*\d")


def words_of(texts: Iterable[str]) -> Counter:
    """Ordinary words and names with their numbers."""
    n: Counter = Counter()
    for t in texts:
        n.update(WORD.findall(LONG.sub(" ", t)))
    return Counter({w: k for w, k in n.items() if not MIXED.search(w)})


def examples(c: Candidate) -> list[tuple[Candidate, int | None]]:
    """A candidate with its label, and of each third secret the same place with a reference or placeholder in it, which is no secret."""
    y = label(c)
    out = [(c, y)]
    k = zlib.crc32(f"{c.before}\0{c.value}".encode())
    if y and c.form != "pem" and k % 3 == 0:
        v = INSTEAD[k // 3 % len(INSTEAD)]
        out.append((replace(c, value=v, end=c.start + len(v), features=[], name=None), 0))
    return out


def held(c: Candidate) -> bool:
    """A fifth of the values is held out."""
    return zlib.crc32(c.value.encode()) % 5 == 0


def _scores(w: np.ndarray, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Raw scores of candidates with n features each, which x has one after another."""
    return np.add.reduceat(w[x], np.cumsum(n) - n)


def _slope(w: np.ndarray, cost: tuple[float, float], x: np.ndarray, n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The slope of the loss over these candidates, and at last the loss, in whole parts."""
    z = np.clip(_scores(w, x, n), -30, 30)
    p, c = 1 / (1 + np.exp(-z)), np.where(y > 0, *cost)
    slope = np.bincount(x, np.repeat(np.rint(c * (p - y) * WHOLE), n), 1 << BITS)
    return np.append(slope, np.rint(c * np.log1p(np.exp(np.where(y > 0, -z, z))) * WHOLE).sum()).astype(np.int64)


def _spectrum(w: np.ndarray, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of these candidates have each raw score, by label."""
    z = np.rint((np.clip(_scores(w, x, n), -30, 30) + 30) * BINS).astype(np.int64)
    return np.bincount(z * 2 + (y > 0), minlength=2 * (60 * BINS + 1))


def least(value: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int) -> np.ndarray:
    """Where a smooth convex function is least (L-BFGS): value gives it and its slope."""
    w = np.zeros(size)
    f, g = value(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(STEPS):
        q, shares = g.copy(), []
        for s, d, rho in reversed(past):
            shares.append(rho * (s @ q))
            q -= shares[-1] * d
        q *= 1 / (past[-1][2] * (past[-1][1] @ past[-1][1])) if past else min(1.0, 1 / max(1e-12, np.abs(g).sum()))
        for (s, d, rho), a in zip(past, reversed(shares)):
            q += s * (a - rho * (d @ q))
        step, fall = 1.0, float(g @ q)
        while step > 1e-3:
            there = w - step * q
            f2, g2 = value(there)
            if f2 <= f - 1e-4 * step * fall:
                break
            step /= 2
        else:
            break
        s, d, done = there - w, g2 - g, f - f2 <= 1e-4 * f
        if s @ d > 1e-12:
            past = [*past[1 - KEPT :], (s, d, 1 / float(s @ d))]
        w, f, g = there, f2, g2
        if done:
            break
    return w


def weights(total: Callable[..., np.ndarray], n: int, hot: int) -> np.ndarray:
    """The regression over n labelled candidates of which so many are secrets; total(_slope, w, cost) sums over all of them."""
    if not 0 < hot < n:
        return np.zeros(1 << BITS)
    share = hot / n
    cost = (min(20.0, 0.5 / share), 0.5 / (1 - share))

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        got = total(_slope, w, cost) / WHOLE
        return (float(got[-1]) + RIDGE / 2 * float(w @ w)) / n, (got[:-1] + RIDGE * w) / n

    return least(value, 1 << BITS)


def calibrated(spectrum: np.ndarray) -> tuple[tuple[float, float], dict[str, float]]:
    """Scale and shift of the score by the labels held out, and how right it is on them."""
    by = spectrum.reshape(-1, 2).astype(float)
    z, n, hot = np.arange(len(by)) / BINS - 30, by.sum(1), by[:, 1]
    a, b, size = 1.0, 0.0, float(by.sum())
    chance = lambda: 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
    if 0 < hot.sum() < size:
        for _ in range(300):
            d = chance() * n - hot
            a, b = a - 0.05 * float((d * z).sum() / size) / max(1.0, float((z * z * n).sum() / size) ** 0.5), b - 0.05 * float(d.sum() / size)
    p = chance() >= THRESHOLD
    hit = float(hot[p].sum())
    return (a, b), {"n": size, "precision": hit / max(1.0, float(n[p].sum())), "recall": hit / max(1.0, float(hot.sum()))}


def fit(texts: list[tuple[str, str | None]], without: str | None = None) -> Model:
    """Chain, regression and calibration from weakly labelled candidates of the given (text, tool), as trained() fits them over a table.

    Held out are a fifth of the values, or with ``without`` all candidates of that form, of which no label is then seen.
    """
    words = words_of(t for t, _ in texts)
    chain = Chain(Chain.counts(list(words), words.values()))
    rows = [(described(x, chain, file_of(t, tool)), y, held(x) if without is None else x.form == without) for t, tool in texts for c in candidates(t) for x, y in examples(c) if y is not None]

    def total(out: bool) -> Callable[..., np.ndarray]:
        own = [(f, y) for f, y, k in rows if k == out]
        x = np.array([i for f, _ in own for i in f], np.int64)
        n, y = np.array([len(f) for f, _ in own], np.int64), np.array([y for _, y in own], np.int64)
        return lambda fn, *given: fn(*given, x, n, y) if own else np.zeros(2 * (60 * BINS + 1), np.int64)

    w = weights(total(False), sum(not k for _, _, k in rows), sum(y for _, y, k in rows if not k))
    return Model(chain, w, *calibrated(total(True)(_spectrum, w)))


def secrets(text: str, tool: str | None, model: Model) -> list[tuple[int, int, float]]:
    """Spans of the text that hold a credential, with their calibrated score."""
    file = file_of(text, tool)
    out: list[tuple[int, int, float]] = []
    for c in sorted(candidates(text), key=lambda c: (c.start, -c.end)):
        p = model.probability(c, file)
        if p >= THRESHOLD and not (out and c.start < out[-1][1]):
            out.append((c.start, c.end, p))
    return out


def masked(text: str, spans: list[tuple[int, int, float]]) -> str:
    out, at = [], 0
    for lo, hi, _ in spans:
        if lo >= at:
            out += [text[at:lo], MASK]
            at = hi
    return "".join([*out, text[at:]])


def _fields(observations: DataFrame, names: tuple[str, ...]) -> DataFrame:
    some = F.array(*(F.struct(F.lit(n).alias("field_name"), F.col(n).alias("text")) for n in names))
    o = observations.where("obs_id is not null").select("obs_id", "tool_name", F.inline(some))
    return spread(o.where("text is not null and text <> ''"))


FIELDS = ("tool_input", "tool_output", "user_prompt")


CANDIDATE = "obs_id string, field_name string, label int, held boolean, value string, tail string, features binary, words array<string>, counts array<int>"
EXAMPLE = "obs_id string, field_name string, label int, held boolean, features binary"
PA = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, PA[k]) for c, k in zip(zip(*rows), kinds)], names=list(names))


def _bytes(features: list[int]) -> bytes:
    return np.array(features, np.uint16).tobytes()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each candidate, with obs_id null for those that only the fit sees; a row for the words of each batch."""
    for b in batches:
        rows, known, texts = [], {}, b.column("text").to_pylist()
        for o, tool, name, text in zip(*(b.column(c).to_pylist() for c in ("obs_id", "tool_name", "field_name")), texts):
            if (tool, text) not in known:
                file = file_of(text, tool)
                known[tool, text] = [(x is c, y, held(x), x.value, tail, _bytes(f)) for c in candidates(text) for x, y in examples(c) for f, tail in [before_chain(x, file)]]
            rows += [(o if own else None, name, *x, None, None) for own, *x in known[tool, text]]
        words = words_of(texts)
        if words:
            rows.append((*[None] * 7, list(words), list(words.values())))
        if rows:
            yield _batch(rows, CANDIDATE)


def _summed(rows: DataFrame, fn: Callable[..., np.ndarray], *given) -> np.ndarray:
    """The sum of fn(*given, features, number of features, label) over all rows; the driver gets at most one sum for each core."""
    sent = rows.sparkSession.sparkContext.broadcast((fn, given))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, (fn, given) = None, sent.value
        for b in batches:
            if b.num_rows:
                f = b.column("features")
                at = np.frombuffer(f.buffers()[1], np.int32)[f.offset : f.offset + len(f) + 1] // 2
                x = np.frombuffer(f.buffers()[2], np.uint16, at[-1])[at[0] :].astype(np.int64)
                got = fn(*given, x, np.diff(at), b.column("label").to_numpy(zero_copy_only=False).astype(np.int64))
                out = got if out is None else out + got
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sum"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [np.frombuffer(x, np.int64) for b in batches for x in b.column("sum").to_pylist()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([sum(out[1:], out[0]).tobytes()], pa.binary())], names=["sum"])

    parts = rows.select("features", "label").mapInArrow(part, "sum binary").repartition(cores(rows.sparkSession)).mapInArrow(join, "sum binary").collect()
    sent.destroy()
    return sum((np.frombuffer(r["sum"], np.int64) for r in parts[1:]), np.frombuffer(parts[0]["sum"], np.int64)) if parts else np.zeros(2 * (60 * BINS + 1), np.int64)


def trained(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The models, from all of the texts, and the candidates of these (obs_id, field_name, features)."""
    spark = texts.sparkSession
    with shuffles_dropped(spark):
        read = written(texts.mapInArrow(_read, CANDIDATE), "credentials-read")
        words = read.where("words is not null").select(F.inline(F.arrays_zip("words", "counts"))).groupBy("words").agg(F.sum("counts").alias("n"))

        def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = sum((Chain.counts(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches), np.zeros(Chain.SIZE**3, np.int64))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["at", "n"])

        counts = words.mapInArrow(follow, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
        chain = Chain(dense(counts, 1 << 17, np.int64)[: Chain.SIZE**3])
        sent = spark.sparkContext.broadcast(chain)

        def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cols = [b.column(c).to_pylist() for c in ("obs_id", "field_name", "label", "held", "value", "tail", "features")]
                if b.num_rows:
                    yield _batch([(*x, _bytes(completed(np.frombuffer(f, np.uint16).tolist(), tail, sent.value.score(v)))) for *x, v, tail, f in zip(*cols)], EXAMPLE)

        rows = written(read.where("features is not null").select(*read.columns[:7]).mapInArrow(complete, EXAMPLE), "credentials-examples")
        known = rows.where("label is not null")
        n, hot = known.where("not held").agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        w = weights(lambda *x: _summed(known.where("not held"), *x), n, hot)
        return Model(chain, w, *calibrated(_summed(known.where("held"), _spectrum, w))), rows.where("obs_id is not null").select("obs_id", "field_name", "features")


def scanned(observations: DataFrame, names: tuple[str, ...] = FIELDS) -> DataFrame:
    """(obs_id, field_name, n_secrets, score, masked) of every field that holds a credential."""
    texts = _fields(observations, names)
    model = observations.sparkSession.sparkContext.broadcast(trained(texts)[0])
    schema = "obs_id string, field_name string, n_secrets int, score double, masked string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            rows, known = [], {}
            for o, tool, name, text in zip(*(b.column(c).to_pylist() for c in ("obs_id", "tool_name", "field_name", "text"))):
                if (tool, text) not in known:
                    known[tool, text] = secrets(text, tool, m)
                found = known[tool, text]
                if found:
                    rows.append((o, name, len(found), max(p for _, _, p in found), masked(text, found)))
            if rows:
                cols = list(zip(*rows))
                kinds = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return texts.mapInArrow(scan, schema)


def found(observations: DataFrame) -> DataFrame:
    """Fields that hold a credential: a candidate that reaches THRESHOLD is one, or lies in another one."""
    model, rows = trained(_fields(observations, FIELDS))
    sent = observations.sparkSession.sparkContext.broadcast((model.weights, model.scale))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, (a, b) = sent.value
        for batch in batches:
            if batch.num_rows:
                f = batch.column("features").to_pylist()
                z = a * np.array([w[np.frombuffer(x, np.uint16)].sum() for x in f]) + b
                hit = 1 / (1 + np.exp(-np.clip(z, -30, 30))) >= THRESHOLD
                yield batch.select(["obs_id", "field_name"]).filter(pa.array(hit))

    return rows.mapInArrow(score, "obs_id string, field_name string").distinct()
