"""Personal data: exact patterns, and a character BiLSTM with CRF transitions that adds what they miss.

Windows overlap by half: every character takes its label from the window in whose middle it stands,
and spans are read off the labels of the whole text. What the model adds is cut to a form of its kind,
must be a possible value, and lies apart from the patterns' spans.

All forms hold a trigger: a digit or a mark of an e-mail (@, [at], (at)). So a labelled span counts only
if it holds one, and the windows in whose middle no trigger stands matter only where a
span reaches into them. Those around triggers are read first, then, as long as a span is open at the
edge of what has been read, the windows behind that edge: the spans are those of reading every window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from seqloom.llm import lstmcrf
from seqloom.llm.common import Carried, whole_text

#: Kinds in the order of the result; labels are 0 (none), then begin and inside of each.
KINDS = ("email", "ip", "card", "phone")
WIDTH = 64
#: Bounds of the training set: documents that lend their words, characters of one (longer ones lend none), and windows.
DOCUMENTS, LONGEST, WINDOWS = 300, 20_000, 2500
EPOCHS = 8

Span = tuple[int, int, int]  # kind's number, start, end

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits that does not match from its first digit does not from later ones
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|\[at\]|\(at\)")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def is_card(s: str) -> bool:
    d = digits_of(s)
    return 14 <= len(d) <= 19 and luhn(d)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As a leftmost search with one pattern, but going out from each @, so in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        found = _DOMAIN.match(text, at) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
        at = text.find("@", max(done, at + 1))


def patterns(text: str) -> list[Span]:
    """Spans of the exact patterns, by start and kind."""
    out = [(0, a, b) for a, b in emails(text)]
    if any(c in text for c in "0123456789"):
        out += [(1, *m.span()) for m in _IP.finditer(text) if is_ip(m.group())]
        out += [(2, *m.span()) for m in _CARD.finditer(text) if is_card(m.group())]
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


#: Forms in which a value of each kind may be written, wider than the patterns; none crosses a line.
_AT, _DOT = r" ?(?:@|\[at\]|\(at\)) ?", r"(?:\.|\[\.\]|\(\.\)|\[dot\])"
_FORMS = (
    re.compile(rf"[A-Za-z0-9_%+-](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+"),
    re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?: ?{_DOT} ?[0-9]{{1,3}}){{3}}(?!\.?[0-9])"),
    re.compile(r"(?<![0-9])[0-9](?:[ .\-/]?[0-9]){12,18}(?![0-9])"),
    re.compile(r"(?<![0-9+])(?:(?:\+|00)[0-9]{1,3}[ .\-/]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .\-/]?[0-9]{3}[ .\-/]?[0-9]{4}(?![0-9]|[.\-/][0-9])"),
)
#: Characters beside a labelled run in which its form may begin or end.
REACH = 40


def is_isbn(d: str) -> bool:
    return len(d) == 13 and d[:3] in ("978", "979") and sum(int(c) * (1 + 2 * (k % 2)) for k, c in enumerate(d)) % 10 == 0


def possible(kind: int, s: str) -> bool:
    """Whether a text of a kind's form can be a value of it."""
    d = digits_of(s)
    if kind == 1:
        return is_ip(re.sub(r"[^0-9.]", "", re.sub(_DOT, ".", s)))
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d) and not is_isbn(d)
    return kind == 0 or 10 <= len(d) <= 15 and len(d) < len(s) and not is_isbn(d)


# -- training data: labelled spans in words of the corpus


def _card(rng: np.random.Generator) -> str:
    d = [int(x) for x in rng.integers(0, 10, int(rng.choice([14, 15, 15, 15, 18])))]
    total = sum((x * 2 - 9 * (x > 4)) if k % 2 == 0 else x for k, x in enumerate(reversed(d)))
    s = "".join(map(str, d)) + str(-total % 10)
    gap = str(rng.choice(["", "", " ", "-", "."]))
    return gap.join(s[k : k + 4] for k in range(0, len(s), 4)) if gap else s


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _value(rng: np.random.Generator, kind: int, word: str) -> str:
    n = lambda a, b: int(rng.integers(a, b))
    if kind == 0:
        at = str(rng.choice(["@", "@", " @ ", " @ ", "[at]", "(at)", " [at] ", " (at) "]))
        host = str(rng.choice(["mail", "post", "corp", "web", "shop", "info"])) + str(rng.choice(["", str(n(1, 99))]))
        return f"{word.strip('.,') or 'x'}{rng.choice(['', '.', '_', '-'])}{rng.choice(['', _digits(rng, n(1, 4))]) or 'a'}{at}{host}.example.{rng.choice(['com', 'org', 'net', 'co.uk'])}"
    if kind == 1:
        dot = str(rng.choice([".", ".", "[.]", "(.)", " . "]))
        return dot.join(str(n(0, 256)) for _ in range(4))
    if kind == 2:
        return _card(rng)
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    form = n(0, 8)
    head = "+" + str(n(1, 99)) + " "
    return [f"{head}({a}) {b}-{c}", f"{head}{a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{n(1, 99)} {a} {b}{c}", f"{head}{a}-{b}-{c}", f"{a} {b} {c}"][form]


def _isbn(rng: np.random.Generator) -> str:
    d = str(rng.choice(["978", "979"])) + _digits(rng, 9)
    d += str(-sum(int(c) * (1 + 2 * (k % 2)) for k, c in enumerate(d)) % 10)
    return f"{d[:3]}-{d[3]}-{d[4:6]}-{d[6:12]}-{d[12]}" if rng.random() < 0.7 else d


def _decoy(rng: np.random.Generator) -> str:
    n = lambda a, b: int(rng.integers(a, b))
    return [
        _digits(rng, n(1, 12)),
        f"{n(1900, 2100)}-{n(1, 13):02d}-{n(1, 29):02d}",
        f"{n(1, 30)}.{n(1, 13)}.{n(1900, 2100)}",
        f"v{n(0, 20)}.{n(0, 20)}.{n(0, 20)}",
        f"{n(300, 999)}.{n(300, 999)}.{n(0, 999)}.{n(0, 999)}",
        f"{n(0, 24):02d}:{n(0, 60):02d}",
        f"{n(1, 1000)},{n(100, 999)}.{n(0, 99):02d}",
        "".join(rng.choice(list("0123456789abcdef"), n(8, 40))),
        f"@{'ab' * n(1, 4)}",
        f"{n(1, 99)}%",
        f"http://x{n(1, 99)}.example.com/{n(1, 9999)}",
        _isbn(rng),
        f"{_digits(rng, n(1, 4))} {_digits(rng, n(1, 4))}",
        f"{n(1900, 2100)} {n(1, 1000)} {n(1, 100)}",
    ][n(0, 14)]


def training_windows(words: list[str], windows: int = WINDOWS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and labels of windows with known spans: values of all kinds and decoys among the given words."""
    rng = np.random.default_rng(seed)
    words = words or ["the", "of", "and", "word"]
    xs, ys = np.full((windows, WIDTH), lstmcrf.PAD, np.int16), np.zeros((windows, WIDTH), np.int8)
    for row in range(windows):
        text, labels = "", []
        while len(text) < 2 * WIDTH:
            word = words[int(rng.integers(len(words)))]
            draw, kind = rng.random(), -1
            if draw < 0.24:
                kind = int(rng.integers(4))
                piece = _value(rng, kind, word)
            else:
                piece = _decoy(rng) if draw < 0.36 else word
            mark = [0] * len(piece) if kind < 0 else [1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1)
            tail = str(rng.choice([" ", " ", " ", " ", ". ", ", ", "\n", "%%% "]))
            text, labels = text + piece + tail, labels + mark + [0] * len(tail)
        begin = int(rng.integers(0, WIDTH))
        shown = np.array([ord(c) for c in text[begin : begin + WIDTH]])
        xs[row] = lstmcrf.symbols(shown)
        ys[row] = labels[begin : begin + WIDTH]
    return xs, ys


def fit(docs: DataFrame, text: str = "text", documents: int = DOCUMENTS, windows: int = WINDOWS) -> lstmcrf.Params:
    """Train on spans set among the words of a bounded sample of documents (by hash of the text).

    Hashes below a bound that lets some twice the sample through are looked at, so that no task sends
    more than its share; copies fall together before they travel. No documents: a few fixed words.
    """
    source = docs.select(whole_text(text).alias("t")).where(F.length("t") <= LONGEST)
    share = min(1.0, 2 * documents / max(1, docs.count()))
    held = source.withColumn("h", F.xxhash64("t")).where(F.col("h") <= min(int(share * 2**64) - 2**63, 2**63 - 1))
    rows = held.groupBy("h").agg(F.min("t").alias("t")).orderBy("h").limit(documents).collect()
    words = sorted({w for r in rows for w in r["t"].split() if not _TRIGGER.search(w) and len(w) <= 20})
    x, y = training_windows(words, windows)
    return lstmcrf.train(x, y, 1 + 2 * len(KINDS), EPOCHS)


# -- decoding


class Reading:
    """The windows of one text: window k covers half windows k - 1 and k, and labels the middle of that stretch."""

    HALF, QUARTER = WIDTH // 2, WIDTH // 4

    def __init__(self, text: str, every: bool = False):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.length = len(points)
        # a window's middle begins a quarter behind its begin; window 0 begins half a window before the text
        self.many = (self.length + self.QUARTER) // self.HALF + 1
        self.padded = np.full((self.many + 2) * self.HALF, lstmcrf.PAD, np.int16)
        self.padded[self.HALF : self.HALF + self.length] = lstmcrf.symbols(points)
        self.labels = np.full(self.length, -1, np.int8)
        if every:
            self.want = np.arange(self.many)
            return
        hit = np.flatnonzero((points == 64) | (points >= 48) & (points <= 57))
        if "[at]" in text or "(at)" in text:
            hit = np.concatenate([hit, *(np.arange(*m.span()) for m in _TRIGGER.finditer(text) if m.end() - m.start() > 1)])
        self.want = np.unique(self.window(hit))

    def window(self, at: np.ndarray) -> np.ndarray:
        """The window in whose middle a character stands."""
        return (at + self.QUARTER) // self.HALF

    def rows(self) -> np.ndarray:
        return self.padded[self.want[:, None] * self.HALF + np.arange(WIDTH)[None, :]]

    def take(self, labels: np.ndarray) -> None:
        """Keep the labels of the wanted windows' middles; then want those that a span at an edge may reach into."""
        at = self.want[:, None] * self.HALF - self.QUARTER + np.arange(self.HALF)[None, :]
        mid = labels[:, self.QUARTER : WIDTH - self.QUARTER]
        there = (at >= 0) & (at < self.length)
        self.labels[at[there]] = mid[there]
        known = self.labels >= 0
        # a span goes on behind a labelled character, and one may begin before an inside label
        after = np.flatnonzero(known[:-1] & ~known[1:] & (self.labels[:-1] > 0)) + 1
        before = np.flatnonzero(~known[:-1] & known[1:] & (self.labels[1:] > 0))
        self.want = np.unique(self.window(np.concatenate([after, before])))


def read(readings: list[Reading], model: lstmcrf.Params) -> list[np.ndarray]:
    """Labels of all characters; 0 where no span that counts can stand."""
    todo = [r for r in readings if len(r.want)]
    while todo:
        rows = np.concatenate([r.rows() for r in todo])
        labels = np.concatenate([lstmcrf.decode(model, rows[j : j + 1024]) for j in range(0, len(rows), 1024)])
        at = 0
        for r in todo:
            n = len(r.want)
            r.take(labels[at : at + n])
            at += n
        todo = [r for r in todo if len(r.want)]
    return [np.maximum(r.labels, 0) for r in readings]


def spans_of(labels: np.ndarray) -> list[Span]:
    """Runs of one kind; a begin label inside a run starts another."""
    kind = (labels.astype(np.int64) + 1) // 2
    opens = np.flatnonzero((kind > 0) & ((labels % 2 == 1) | (kind != np.concatenate([[0], kind[:-1]]))))
    out = []
    for k, a in enumerate(opens.tolist()):
        stop = int(opens[k + 1]) if k + 1 < len(opens) else len(kind)
        run = np.flatnonzero(kind[a:stop] != kind[a])
        out.append((int(kind[a]) - 1, a, a + int(run[0]) if len(run) else stop))
    return out


def added(text: str, base: list[Span], labels: np.ndarray) -> list[Span]:
    """The values of their kind's form on which the model's spans lie, apart from the spans of the patterns.

    A labelled run must hold a trigger; what is found is the form's first match that has more than half of
    itself in the run, which so loses what does not belong to it and gains what the model has left out.
    """
    out = set()
    for kind, a, b in spans_of(labels):
        if not _TRIGGER.search(text, a, b):
            continue
        low, high = max(0, a - REACH), min(len(text), b + REACH)
        line = text.rfind("\n", low, a) + 1
        for m in _FORMS[kind].finditer(text, max(low, line), high):
            s, e = m.span()
            if s >= b:
                break
            whole = s > low or s == 0 or not text[s - 1].isalnum()
            if whole and 2 * (min(e, b) - max(s, a)) > e - s and possible(kind, m.group()) and all(e <= x or y <= s for _, x, y in base):
                out.add((kind, s, e))
                break
    # two kinds may claim one place: the longer, then the first kind
    kept: list[Span] = []
    for q, s, e in sorted(out, key=lambda x: (x[1] - x[2], x[0], x[1])):
        if all(e <= x or y <= s for _, x, y in kept):
            kept.append((q, s, e))
    return kept


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: lstmcrf.Params, text: str = "text") -> DataFrame:
    """Add ``base`` and ``spans``: arrays of (kind, start, end) in code points, by start and kind.

    base holds the spans of the patterns, spans those and what the model adds. Null and empty texts
    have none. Columns of those names are replaced, repeated rows stay.
    """
    kind = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))
    carried = Carried(docs, text, [("base", kind), ("spans", kind)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in carried.slices(batches):
            base, more = find_in(texts.to_pylist(), shared.value)
            yield carried.batch(part, [pa.array([[{"kind": KINDS[q], "start": a, "end": b} for q, a, b in row] for row in rows], arrow) for rows in (base, more)])

    return carried.source.mapInArrow(work, carried.schema)


def find_in(texts: list[str], model: lstmcrf.Params, every: bool = False) -> tuple[list[list[Span]], list[list[Span]]]:
    """Spans of the patterns, and all spans, of every text; ``every`` reads all windows, to the same result."""
    base: list[list[Span]] = [[] for _ in texts]
    spans: list[list[Span]] = [[] for _ in texts]
    todo = [t for t, s in enumerate(texts) if every or _TRIGGER.search(s)]
    for k in range(0, len(todo), 64):
        some = todo[k : k + 64]
        for t, labels in zip(some, read([Reading(texts[t], every) for t in some], model)):
            base[t] = patterns(texts[t])
            spans[t] = sorted(base[t] + added(texts[t], base[t], labels), key=lambda s: (s[1], s[0], s[2]))
    return base, spans
