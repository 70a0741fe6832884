"""Per-document text quality: ratios over the whole text, and blocks told apart as list, table, junk or other.

A document is cut into blocks of consecutive non-blank lines (cell markers, code fences and comment prefixes of
exported notebooks are taken off first, notebooks stored as JSON are decoded).  What a block is shows in its structure
and its ratios, taken together:

- structure: vertical alignment of delimiters (the same number of tabs, bars, commas or semicolons in nearly every
  line, the same cell edges in columns parted by two or more blanks, rows of table markup), the period of the
  indentation, and the autocorrelation of the line lengths at LAGS;
- ratios: words and characters of a line, share of lines that end in punctuation, symbol ratio, vowels per letter.

Aligned delimiters between brief cells make a table, unless the lines end like sentences.  Marked or brief entries on a
regular indentation, whose lengths neither repeat with a period nor stay the same and which are words more than
symbols, make a list.  Junk is encoded, damaged, repeated or noise: control sequences, mis-decoded bytes, runs of one
character, bars and dumps, long tokens without white space, or words that no reader could pronounce.

These findings are evidence; one linear score for each kind weighs them together with the ratios.  Its weights start at
PRIOR, where the structure alone decides, and are fitted to a bounded sample of labelled documents, held to the prior
the closer the fewer there are.  A document is the kind to which more than half of its characters other than white space
belong.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map

LEAST = 200
#: Distances at which line lengths are compared.
LAGS = (1, 2, 3, 4)
KINDS = ("list", "table", "junk")

_CELL = re.compile(r"^(?:# %%.*|#\s*In\s*\[.*\]:?.*|```.*|~~~.*)$")
_MARK = re.compile(r"\s*(?:[-*+•‣◦▪–·]|\(?(?:\d{1,4}|[a-zA-Z]|[ivxlc]{1,5})[.)]|\[[ xX]\])\s+\S")
_CODE = re.compile(r"^\s*(?:import|from|def|class|return|for|while|if|elif|else|try|except|with|print|assert|raise|@)\b|[=(){};]|::|->")
_ENDS = frozenset(".!?:…»\"”")
_ASCII_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_ASCII_DIGITS, _ASCII_SPACE = b"0123456789", b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
_END = re.compile(r"[.!?:…»\"”]$")
_MARKUP = re.compile(r"\s*</?(?:table|thead|tbody|tr|td|th)\b", re.I)
_RULE = re.compile(r"[\s|+:=\-─━┼┬┴├┤╪]+")
_RUN = re.compile(r"(\S)\1{7,}")
_UNIT = re.compile(r"(\S{2,32}?)\1{3,}")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1b]|\[\d*[mKJH]")
_BLOCKS = re.compile(r"[▀-▟]")
_ODD = re.compile(r"[\u0080-¿ÂÃâïŒœ€™‘-„†-•ˆ˜�]")
_SYMBOL = re.compile(r"[^\w\s]|_")
_DIGITS = re.compile(r"\d")
_LETTERS = re.compile(r"[^\W\d_]+")
_VOWEL = re.compile(r"[aeiouyàáâäåæèéêëìíîïòóôöøùúûüœ]")
_CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxzß]{5,}")
_NO_VOWELS = dict.fromkeys(map(ord, "aeiouyàáâäåæèéêëìíîïòóôöøùúûüœ"))
_HEX_PAIR = re.compile(r"(?<!\S)[0-9a-fA-F]{2}(?!\S)")
_LONG = re.compile(r"\S{40,}")
_MIDDLING = re.compile(r"\S{16,}")
_COLUMNS = re.compile(r"\S+(?: \S+)*")


def lines_of(text: str) -> list[str]:
    """Lines with cell markers and fences blanked, comment prefixes of non-code cells removed, JSON decoded.

    A text is a JSON notebook if it is a JSON object with a list of cells that have a source, in whatever order its
    names stand.
    """
    if text[:1] == "{" and '"cells"' in text:
        try:
            cells = json.loads(text)["cells"]
            sources = ["".join(c["source"]) if isinstance(c["source"], list) else str(c["source"]) for c in cells]
            return "\n\n".join(sources).splitlines()
        except (ValueError, KeyError, TypeError, RecursionError):
            pass
    out, prefixed = [], False
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if _CELL.match(line):
            prefixed = line.startswith("# %%") and ("[" in line and "In" not in line)
            out.append("")
        elif prefixed and line[:1] == "#":
            out.append(line[2:] if line[1:2] == " " else line[1:])
        else:
            out.append(line)
    return out


def _modal(counts: list[int]) -> tuple[int, float]:
    value, n = Counter(counts).most_common(1)[0]
    return value, n / len(counts)


def autocorrelation(lengths: list[int], lag: int = 1) -> float:
    """Autocorrelation of line lengths; 1 for lines of equal length."""
    x = np.asarray(lengths, float)
    if len(x) <= lag + 1:
        return 0.0
    x = x - x.mean()
    total = float((x * x).sum())
    return 1.0 if total == 0 else float((x[:-lag] * x[lag:]).sum()) / total


def rhythm(lengths: list[int]) -> float:
    """The highest autocorrelation of line lengths at any of LAGS; 1 for lines of equal length."""
    n = len(lengths)
    if n <= LAGS[0] + 1:
        return 0.0
    x = np.array(lengths, float)
    x -= x.sum() / n
    total = float(x @ x)
    return max(float(x[:-lag] @ x[lag:]) if n > lag + 1 else 0.0 for lag in LAGS) / total if total else 1.0


def indent_period(lines: list[str]) -> float:
    """Share of lines whose indentation is a multiple of the most common step from one line to the next (of equally
    common ones the smallest); 1 without steps."""
    depths = [len(x) - len(x.lstrip()) for x in lines]
    steps = Counter(abs(b - a) for a, b in zip(depths, depths[1:]) if a != b)
    if not steps:
        return 1.0
    step = min(steps, key=lambda d: (-steps[d], d))
    least = min(depths)
    return sum((d - least) % step == 0 for d in depths) / len(depths)


def line_end_share(lines: list[str]) -> float:
    """Share of lines that end like a sentence."""
    return sum(x.rstrip()[-1:] in _ENDS for x in lines) / len(lines)


def counts(text: str) -> tuple[int, int, int]:
    """Letters, digits and symbols (what is neither of them nor white space) of *text*."""
    if text.isascii():
        raw = text.encode()
        n, other = len(raw), len(raw.translate(None, _ASCII_LETTERS))
        rest = len(raw.translate(None, _ASCII_LETTERS + _ASCII_DIGITS))
        return n - other, other - rest, len(raw.translate(None, _ASCII_LETTERS + _ASCII_DIGITS + _ASCII_SPACE))
    return sum(map(len, _LETTERS.findall(text))), len(_DIGITS.findall(text)), len(_SYMBOL.findall(text))


def symbol_ratio(text: str, solid: int) -> float:
    """Share of characters other than letters, digits and white space among those other than white space."""
    return counts(text)[2] / solid if solid else 0.0


def _is_table(lines: list[str]) -> bool:
    n = len(lines)
    if sum(bool(_MARKUP.match(x)) for x in lines) >= 0.6 * n:
        return True
    if n < 3:
        return False
    # Bars, also with ruled lines between the rows.
    barred = sum("|" in x or "│" in x for x in lines) >= 0.4 * n
    rows = [x for x in lines if not _RULE.fullmatch(x)] if barred else []
    if len(rows) >= 2:
        m, share = _modal([x.count("|") + x.count("│") for x in rows])
        if m >= 2 and share >= 0.8 and sum(x.strip()[:1] in "|│" for x in rows) >= 0.7 * len(rows):
            return True
        if m >= 1 and share >= 0.9 and len(rows) < n and not any("%" in x for x in rows):
            return True
    for d, least in (("\t", 1), (",", 2), (";", 2), ("|", 2)):
        if sum(d in x for x in lines) < 0.8 * n:
            continue
        counts = [x.strip().count(d) if d != "\t" else x.count(d) for x in lines]
        m, share = _modal(counts)
        if m >= least and share >= 0.8:
            cells = [c.strip() for x in lines for c in x.split(d)]
            brief = sum(len(c) <= 24 and c.count(" ") <= 2 for c in cells) >= 0.9 * len(cells)
            plain = sum(any(b in c for b in "()={}") for c in cells) <= 0.1 * len(cells)
            spaced = sum(x.count(d + " ") for x in lines) > 0.5 * sum(counts)
            if brief and plain and not (spaced and d in ",;" and line_end_share(lines) > 0.3):
                return True
    # Columns parted by blanks: the same number of cells, their right or left edges in the same places.
    if sum("  " in x.strip() for x in lines) < 0.7 * n:
        return False
    cells = [[m.span() for m in _COLUMNS.finditer(x)] for x in lines]
    m, share = _modal([len(c) for c in cells])
    ahead, part = _modal([len(c) for c in cells[1:]])
    if max(m, ahead) >= 3 and max(share, part) >= 0.75:
        edges = Counter(e for c in cells for e in {x for s in c for x in (s[0], ~s[1])})
        if sum(v >= 0.75 * n for v in edges.values()) >= 2:
            return True
    return False


def _is_junk(lines: list[str], text: str, solid: int, control: int) -> bool:
    """Encoded, damaged, repeated or noise characters; *solid* is the number of characters other than white space,
    *control* that of control sequences."""
    if 6 * control >= 0.1 * solid and control >= 0.5 * len(lines):
        return True
    if sum(len(m[0]) for m in _RUN.finditer(text)) >= 0.5 * solid:
        return True
    if not text.isascii() and len(_ODD.findall(text)) >= 0.15 * solid:
        return True
    if sum(map(len, _LONG.findall(text))) >= 0.5 * solid:
        return True
    tokens = len(text.split())
    if tokens >= 8 and len(_HEX_PAIR.findall(text)) >= 0.6 * tokens:
        return True
    periodic = " ".join(_MIDDLING.findall(text))
    if len(periodic) >= 0.5 * solid and sum(len(m[0]) for m in _UNIT.finditer(periodic)) >= 0.5 * solid:
        return True
    lower = text.lower()
    vowels = len(lower) - len(lower.translate(_NO_VOWELS))
    if vowels < 0.33 * solid:
        words = [w for w in _LETTERS.findall(lower) if len(w) >= 3]
        letters = sum(map(len, words))
        if len(words) >= 5 and letters >= 0.6 * solid and vowels < 0.33 * letters:
            if sum(w.isascii() and (not _VOWEL.search(w) or bool(_CLUSTER.search(w))) for w in words) >= 0.2 * len(words):
                return True
    return False


def _is_list(lines: list[str], text: str, solid: int) -> bool:
    n = len(lines)
    lengths = [len(x.strip()) for x in lines]
    marked = sum(bool(_MARK.match(x)) for x in lines)
    if n >= 2 and marked >= 0.7 * n:
        # Steps told in whole sentences are prose; entries are brief.
        return sum(k <= 90 for k in lengths) >= 0.7 * n and indent_period(lines) >= 0.7
    if n < 4 or max(lengths) > 60:
        return False
    brief = [x for x, k in zip(lines, lengths) if k <= 40 and len(x.split()) <= 5 and not _CODE.search(x) and not _END.search(x.strip())]
    if len(brief) < 0.8 * n:
        return False
    return line_end_share(lines) <= 0.2 and symbol_ratio(text, solid) < 0.5 and rhythm(lengths) < 0.9


def structure(lines: list[str], text: str, solid: int) -> str:
    """The kind that a block's structure shows; other if none."""
    control = len(_CONTROL.findall(text))
    if _is_junk_first(text, solid, control):
        return "junk"
    if _is_table(lines):
        return "table"
    if _is_list(lines, text, solid):
        return "list"
    return "junk" if _is_junk(lines, text, solid, control) else "other"


def features(lines: list[str]) -> tuple[np.ndarray, int]:
    """(FEATURES of a block of non-blank lines, its characters other than white space)."""
    text = "\n".join(lines)
    tokens = text.split()
    solid = sum(map(len, tokens))
    shows = structure(lines, text, solid)
    lengths = [len(x.strip()) for x in lines]
    letters, digits, symbols = counts(text)
    n = len(lines)
    return np.array([
        1.0, *(float(shows == k) for k in KINDS), indent_period(lines), min(1.0, max(-1.0, rhythm(lengths))), min(n, 30) / 30, min(sum(lengths) / n, 120) / 120,
        min(len(tokens) / n, 20) / 20, min(solid / len(tokens), 20) / 20, symbols / solid, line_end_share(lines), letters / solid, digits / solid,
    ]), solid


#: What a block's score weighs, in this order.
FEATURES = ["one", *(f"structure of a {k}" for k in KINDS), "indentation period", "rhythm of line lengths", "lines", "line length", "words of a line", "word length", "symbol ratio", "line ends", "letters", "digits"]
#: Weights of the kinds and of other by which structure alone decides.
PRIOR = np.zeros((len(FEATURES), len(KINDS) + 1))
PRIOR[1 : 1 + len(KINDS), : len(KINDS)] = 6.0 * np.eye(len(KINDS))
PRIOR[0, -1] = 3.0
#: Labelled documents to which the weights are fitted (those with the smallest hashes of their keys), steps of the fit,
#: and labelled blocks that weigh as much as the prior.
FIT_DOCUMENTS, FIT_STEPS, FIT_PULL = 2_000, 600, 20.0


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a softmax over the kinds and other (numbered in that order) by gradient descent, pulled to PRIOR."""
    weights = PRIOR.copy()
    if not len(y):
        return weights
    wanted = np.eye(PRIOR.shape[1])[y]
    for _ in range(FIT_STEPS):
        score = x @ weights
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        weights -= (x.T @ (p - wanted) + FIT_PULL / 100 * (weights - PRIOR)) / (len(y) + FIT_PULL)
    return weights


def block_kind(lines: list[str], weights: np.ndarray = PRIOR) -> tuple[str, int]:
    """(kind, characters other than white space) of a block of non-blank lines."""
    x, solid = features(lines)
    return (*KINDS, "other")[int(np.argmax(x @ weights))], solid


def _is_junk_first(text: str, solid: int, control: int) -> bool:
    """Noise that could pass for a table or a list: bars, control sequences, dumps."""
    wide = not text.isascii()
    if wide and len(_BLOCKS.findall(text)) >= 0.08 * solid:
        return True
    if control >= 2 and 12 * control >= 0.3 * solid:
        return True
    pairs = len(_HEX_PAIR.findall(text))
    if pairs >= 8 and pairs >= 0.7 * len(text.split()):
        return True
    return wide and len(_ODD.findall(text)) >= 0.25 * solid


def blocks(text: str) -> Iterator[list[str]]:
    """Runs of non-blank lines."""
    block: list[str] = []
    for line in [*lines_of(text), ""]:
        if line and not line.isspace():
            block.append(line)
        elif block:
            yield block
            block = []


def shares(text: str, weights: np.ndarray = PRIOR) -> tuple[dict[str, int], int]:
    """Characters of each kind of block, and all characters other than white space."""
    out: dict[str, int] = dict.fromkeys((*KINDS, "other"), 0)
    for block in blocks(text):
        kind, solid = block_kind(block, weights)
        out[kind] += solid
    return out, len("".join(text.split()))


def text_kind(text: str | None, weights: np.ndarray = PRIOR) -> str | None:
    """list, table or junk if more than half of a text of at least LEAST characters is that, else None."""
    if not text or len(text) < LEAST:
        return None
    parts, solid = shares(text, weights)
    if solid < LEAST:
        return None
    counted = sum(parts.values())
    best = max(KINDS, key=lambda k: parts[k])
    return best if 2 * parts[best] > counted else None


def _examples(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(kind, x) of each labelled document that has a block of at least half of its characters: that block's features."""
    found = []
    for text, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        seen = [features(b) for b in blocks(text)]
        x, solid = max(seen, key=lambda f: f[1], default=(None, 0))
        if x is not None and 2 * solid >= sum(f[1] for f in seen):
            found.append((kind, x))
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.float64()))], ["kind", "x"])


def fitted(docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str) -> np.ndarray:
    """Weights fitted to at most FIT_DOCUMENTS labelled documents; only their features come to the driver.

    Labels count without white space at their ends and in lower case; documents with several different labels, and
    null labels, keys and texts are left out.  Without labels the weights are PRIOR.
    """
    named = labels.select(F.col(label_key).cast("long").alias("id"), F.lower(F.trim(label)).alias("kind")).where("id is not null and kind is not null and kind <> ''")
    one = named.groupBy("id").agg(F.min("kind").alias("kind"), F.max("kind").alias("other")).where("kind = other").select("id", "kind")
    chosen = one.orderBy(F.xxhash64("id"), "id").limit(FIT_DOCUMENTS)
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(chosen), "id").select("text", "kind")
    rows = arrow_map(texts, _examples, "kind string, x array<double>", columns=(0,)).orderBy("kind", "x").collect()
    numbers = {k: i for i, k in enumerate(KINDS)}
    return fit(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([numbers.get(r["kind"], len(KINDS)) for r in rows], int))


def kinds(docs: DataFrame, key: str, text: str, weights: np.ndarray = PRIOR) -> DataFrame:
    """(id, text_kind) of the documents that are lists, tables or junk.

    Null, empty and short texts (fewer than LEAST characters other than white space) are none; rows with a null key
    are left out; a repeated row comes out as often as it stands.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        found = [(i, k) for i, k in ((i, text_kind(t, weights)) for i, t in zip(ids, texts)) if k and i is not None]
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], ["id", "text_kind"])

    return arrow_map(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), run, "id long, text_kind string", columns=(1,))


#: Limit on the list of common words that is written into the plan; the table holds a few hundred at most.
COMMON_LIMIT = 10_000


def statistics(docs: DataFrame, key: str, text: str, common: DataFrame) -> DataFrame:
    """Ratios per document, all inside the JVM: n_words, mean_word_length, symbol_ratio, line_end_share, common_share.

    A word is a longest run of a-z, 0-9 and _ in the lower-cased text.  symbol_ratio is the share of characters other
    than letters, digits and white space among those other than white space; line_end_share that of non-blank lines
    which end in one of ``.!?:;,``; common_share that of words in *common* (any language).  A ratio of nothing, as
    for null, empty and blank texts, is null; counts of such texts are 0.
    """
    listed = [r[0] for r in common.select("word").where("word is not null").distinct().limit(COMMON_LIMIT + 1).collect()]
    if len(listed) > COMMON_LIMIT:
        raise ValueError(f"more than {COMMON_LIMIT} common words")
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.expr("regexp_extract_all(lower(t), '[a-z0-9_]+', 0)")
    base = docs.select(F.col(key), t.alias("t")).select(key, "t", words.alias("words"))
    solid = F.length(F.regexp_replace("t", r"(?U)\s+", ""))
    symbols = F.length(F.regexp_replace("t", r"(?U)[\s\p{L}\p{N}]+", ""))
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", "")) != "")
    ends = F.filter(lines, lambda x: F.regexp_replace(x, r"(?U)\s+$", "").rlike(r"[.!?:;,]$"))
    chars = F.aggregate("words", F.lit(0), lambda a, w: a + F.length(w))
    hits = F.size(F.filter("words", lambda w: w.isin(listed) if listed else F.lit(False)))
    n = F.size("words")
    ratio = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    return base.select(
        key, n.cast("long").alias("n_words"), ratio(chars, n).alias("mean_word_length"), ratio(symbols, solid).alias("symbol_ratio"),
        ratio(F.size(ends), F.size(lines)).alias("line_end_share"), ratio(hits, n).alias("common_share"),
    )
