"""Text functions as column expressions; the stemmer runs on distinct words in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

# ---- words ------------------------------------------------------------------------------------------------------

SEPARATORS = r"[^\p{L}\p{N}\s/.\\-_]"  #: fixed value: what splits tokens; \\-_ is the range from backslash to underscore


def tokens(text: Column) -> Column:
    """Lower-cased tokens of two characters or more, repeats kept; the simple analyzer, without stems."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), SEPARATORS, " "), r"\s+"), lambda t: F.length(t) >= 2)


# Suffix rules of the stemmer, the first that fits counts.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "iser": "ise", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "isation": "ise", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "alise": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = "ement ment tion sion ance ence able ible ism ate iti ous ive ize ise ant ent al er ic ou".split()

_VC = re.compile(r"[aeiouy]+[^aeiouy]+")
_CVC = re.compile(r"[^aeiou][aeiou][^aeiouwxy]$")
_VOWEL = re.compile(r"[aeiou]")
_DOUBLE = re.compile(r"([^aeiou])\1$")


def _weight(base: str) -> int:
    """Number of vowel-consonant groups, y counting as a vowel."""
    return len(_VC.findall(base))


def _restored(base: str) -> str:
    """A base that lost -ed or -ing, with its last letter put right."""
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if _DOUBLE.search(base) and base[-1] not in "lsz":
        return base[:-1]
    return base + "e" if _weight(base) == 1 and _CVC.search(base) else base


def _replaced(word: str, rules: dict[str, str]) -> str:
    suffix = next((s for s in rules if word.endswith(s)), None)
    if suffix is None or not _weight(base := word[: -len(suffix)]):
        return word
    return base + rules[suffix]


def stem(word: str) -> str:
    """Stem of a lower-case word: a variant of Porter's rules with merged fourth step."""
    if len(word) <= 2:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _weight(word[:-3]) else word
    else:
        cut = next((k for s, k in (("ed", 2), ("ing", 3)) if word.endswith(s)), 0)
        if cut and _VOWEL.search(word[:-cut]):
            word = _restored(word[:-cut])
    if word.endswith("y") and _VOWEL.search(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, SECOND), THIRD)
    longest = max((s for s in FOURTH if word.endswith(s)), key=len, default="")
    if longest and _weight(word[: -len(longest)]) > 1:
        word = word[: -len(longest)]
    if word.endswith("e"):
        base = word[:-1]
        if _weight(base) > 1 or (_weight(base) == 1 and not _CVC.search(base)):
            word = base
    return word[:-1] if word.endswith("ll") and _weight(word[:-1]) > 1 else word


@F.pandas_udf(StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def stems(words: DataFrame, word: str = "term") -> DataFrame:
    """(term, stem) of the distinct words."""
    return words.select(word).distinct().withColumn("stem", stem_udf(word))


# Groups of words that find each other.
SYNONYMS = [
    "auth authentication authn authenticating", "authz authorization authorizing", "db database datastore", "perf performance latency throughput slow bottleneck",
    "optim optimization optimizing optimise query-optimization", "k8s kubernetes kube", "config configuration configuring setup", "deps dependencies dependency", "env environment", "fn function",
    "impl implementation implementing", "msg message messaging", "repo repository", "req request", "res response", "ts typescript", "js javascript", "pg postgres postgresql", "err error errors",
    "api endpoint endpoints", "ci continuous-integration", "cd continuous-deployment", "test testing tests", "doc documentation docs", "infra infrastructure", "deploy deployment deploying",
    "cache caching cached", "log logging logs", "monitor monitoring", "observe observability", "sec security secure", "validate validation validating", "migrate migration migrations",
    "debug debugging", "container containerization docker", "crash crashloop crashloopbackoff", "webhook webhooks callback", "middleware mw", "paginate pagination", "serialize serialization",
    "encrypt encryption", "hash hashing",
]


def synonyms() -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for group in SYNONYMS:
        g = [stem(w) for w in group.split()]
        for w in g:
            out.setdefault(w, set()).update(x for x in g if x != w)
    return out


# ---- redaction --------------------------------------------------------------------------------------------------

# Patterns of secrets, applied in this order.
SECRETS = [
    r"(?i)(?:api[_-]?key|secret|token|password|credential|auth)[\s]*[=:]\s*[\"']?[A-Za-z0-9_\-/.+]{20,}[\"']?",
    r"(?i)Bearer\s+[A-Za-z0-9._\-+/=]{20,}",
    r"sk-proj-[A-Za-z0-9\-_]{20,}",
    r"(?:sk|pk|rk|ak)-[A-Za-z0-9][A-Za-z0-9\-_]{19,}",
    r"sk-ant-[A-Za-z0-9\-_]{20,}",
    r"gh[pus]_[A-Za-z0-9]{36,}",
    r"github_pat_[A-Za-z0-9_]{22,}",
    r"xoxb-[A-Za-z0-9\-]+",
    r"AKIA[0-9A-Z]{16}",
    r"AIza[A-Za-z0-9\-_]{35}",
    r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    r"npm_[A-Za-z0-9]{36}",
    r"glpat-[A-Za-z0-9\-_]{20,}",
    r"dop_v1_[A-Za-z0-9]{64}",
]
PRIVATE_TAG = r"(?is)<private>.*?</private>"


def redacted(text: Column) -> Column:
    """Private sections and secrets replaced."""
    out = F.regexp_replace(text, PRIVATE_TAG, "[REDACTED]")
    for p in SECRETS:
        out = F.regexp_replace(out, p, "[REDACTED_SECRET]")
    return out


# ---- sizes, ids, markup -----------------------------------------------------------------------------------------


def estimated_tokens(text: Column, per_token: int = 3) -> Column:
    return F.ceil(F.length(text) / per_token)


def fingerprint(prefix: str, content: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(content, 256), 1, 16))


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def escaped_xml(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def xml_tag(text: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(text, rf"(?s)<{name}>(.*?)</{name}>", 1))


def xml_children(text: Column, parent: str, child: str) -> Column:
    return F.transform(F.regexp_extract_all(xml_tag(text, parent), F.lit(rf"(?s)<{child}>(.*?)</{child}>"), F.lit(1)), lambda x: F.trim(x))


def unwrapped_xml(text: Column, root: str) -> Column:
    """The element ``root`` out of code fences and prose around it."""
    return F.regexp_extract(F.regexp_replace(text, r"```\w*\n?", ""), rf"(?s)(<{root}[ >].*</{root}>)", 1)


# Capitalised words that are no names.
NO_NAMES = (
    "The This That What When Where How Why Who Which Did Does Do Is Are Was Were Has Have Had Can Could Would Should Will May Might If And But Or Not For From With About After "
    "Before Between"
).split()


def entities(query: Column) -> Column:
    """Quoted phrases, then capitalised words that are names, each once."""
    quoted = F.regexp_extract_all(query, F.lit('"([^"]+)"'), F.lit(1))
    words = F.regexp_extract_all(query, F.lit(r"\b([A-Z][a-zA-Z0-9_.-]+)\b"), F.lit(1))
    return F.array_distinct(F.concat(quoted, F.filter(words, lambda w: ~w.isin(NO_NAMES))))


# ---- similarity -------------------------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"


def similarity_tokens(text: Column) -> Column:
    """Distinct blank-separated tokens longer than two characters; CJK tokens count whole and as pairs of characters."""
    raw = F.split(text, r"\s+")
    pairs = lambda t: F.when(
        t.rlike(CJK), F.array_append(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2))), t)
    ).otherwise(F.when(F.length(t) > 2, F.array(t)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(F.transform(raw, pairs)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts by their tokens; texts without tokens are alike only if equal but for blanks."""
    x, y = similarity_tokens(a), similarity_tokens(b)
    flat = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
    exact = F.when(flat(a) == flat(b), 1.0).otherwise(0.0)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), exact).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


# ---- quality scores ---------------------------------------------------------------------------------------------


def _points(*rules: tuple[Column, int]) -> Column:
    out = F.lit(0)
    for when, n in rules:
        out = out + F.when(when, n).otherwise(0)
    return out


def observation_quality(title: Column, narrative: Column, facts: Column, concepts: Column, importance: Column) -> Column:
    n, t, f = F.length(narrative), F.length(title), F.size(facts)
    return _points((f > 0, 25), (f >= 3, 10), (n >= 20, 20), (n >= 50, 5), (t.between(5, 120), 15), (F.size(concepts) > 0, 15), (importance.between(1, 10), 10))


def summary_quality(title: Column, narrative: Column, decisions: Column, files: Column, concepts: Column) -> Column:
    n = F.length(narrative)
    return _points((F.length(title) >= 5, 20), (n >= 20, 25), (n >= 100, 5), (F.size(decisions) > 0, 20), (F.size(files) > 0, 15), (F.size(concepts) > 0, 15))


def context_quality(context: Column, project: Column) -> Column:
    n, tags = F.length(context), F.size(F.regexp_extract_all(context, F.lit(r"(<\w+>)"), F.lit(1)))
    named = (F.length(project) > 0) & F.contains(F.lower(context), F.lower(project))
    return _points((n > 0, 20), (named, 20), (F.contains(context, F.lit("<")), 15), (tags >= 2, 15), (tags >= 4, 10), (n >= 100, 10), (n >= 500, 10))


# ---- raw observations to observations ---------------------------------------------------------------------------

# Words in tool names and the kind of observation they mean, the first group that fits counts.
KINDS = [
    ("web_fetch", "fetch http web"),
    ("search", "grep search glob find"),
    ("command_run", "bash shell exec run"),
    ("file_edit", "edit update patch replace"),
    ("file_write", "write create"),
    ("file_read", "read view"),
    ("subagent", "task agent"),
]
HOOKS = {"post_tool_failure": "error", "prompt_submit": "conversation", "subagent_stop": "subagent", "task_completed": "subagent", "notification": "notification"}
FILE_KEYS = ["file_path", "filepath", "path", "filePath", "file", "pattern"]


def observation_kind(tool: Column, hook: Column) -> Column:
    name = F.lower(F.regexp_replace(F.regexp_replace(tool, r"([a-z])([A-Z])", "$1_$2"), r"[-\s]+", "_"))
    out = F.lit("other")
    for kind, words in reversed(KINDS):
        any_ = "|".join(words.split())
        out = F.when(name.rlike(rf"(^|_)({any_})(_|$)|^({any_})|({any_})$"), kind).otherwise(out)
    for h, kind in HOOKS.items():
        out = F.when(hook == h, kind).otherwise(out)
    return out


def named_files(tool_input: Column) -> Column:
    values = F.array(*(F.get_json_object(tool_input, f"$.{k}") for k in FILE_KEYS))
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & F.length(v).between(1, 511)))


def normalised(raw: DataFrame) -> DataFrame:
    """Observations out of raw ones without any model: titles, narratives and files from what the hook recorded."""
    some = lambda c: F.when(F.length(c) > 0, F.col(c))
    tool = F.coalesce("tool_name", "hook_type")
    return raw.select(
        "obs_id",
        "session_id",
        "ts",
        observation_kind(tool, F.col("hook_type")).alias("type"),
        shortened(F.coalesce(F.when(F.length(tool) > 0, tool), F.lit("observation")), 80).alias("title"),
        shortened(some("tool_input"), 120).alias("subtitle"),
        shortened(F.concat_ws(" | ", some("user_prompt"), some("tool_input"), some("tool_output")), 400).alias("narrative"),
        named_files(F.col("tool_input")).alias("files"),
        F.lit(5).alias("importance"),
        F.lit(0.3).alias("confidence"),
        "agent_id",
    )


def hash_embedding(dim: int = 384):
    """A deterministic stand-in for an embedding model: character codes spread over dimensions, unit length."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        def one(t: str | None):
            if t is None:
                return None
            v = np.zeros(dim, np.float64)
            codes = np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.int64)
            np.add.at(v, (codes * 31 + np.arange(len(codes))) % dim, 1.0)
            n = np.linalg.norm(v)
            return (v / n if n else v).astype(np.float32)

        for s in texts:
            yield s.map(one)

    return embed
