"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field labels words.  Where a text has no digit, at sign or word for one, its words
are outside of any span; stretches around these are decoded, and one with a span near an
end is widened and decoded again.  So the labels are those of the whole text's best path.  The field is
trained once, on the driver, on a small labelled table made by rule in this module.
"""

from __future__ import annotations

import ipaddress
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.kernels import Block, ascii_lower, release, text_blocks, utf8

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
CONTEXT = 3

# The lookbehinds change no match: a match of these patterns takes all digits of a run.
_AT = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(rb"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_OBFUSCATED = (b"(at)", b"[at]", b"{at}")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(data: bytes) -> bytes:
    return bytes(c for c in data if 48 <= c <= 57)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in bytes: leftmost non-overlapping matches of each kind, without those that fail its check."""
    out = []
    if b"@" in text:
        free = 0  # end of the last match
        for m in _AT.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                free = m.end()
    for m in _IP.finditer(text):
        parts = [p.lstrip(b"0") for p in m[0].split(b".")]
        if all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if b"+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# ------------------------------------------------------------------ features


def shape(word: str) -> str:
    """Digits as 9, letters as a or A, runs of letters shortened to one; other characters stay."""
    s = re.sub(r"[0-9]", "9", word)
    s = re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", s)
    return re.sub(r"([aA])\1+", r"\1", s)


def strip(word: str) -> str:
    return word.rstrip(".,;:!?\"'”’»…*#%&$|").lstrip("\"'“‘«*#%&$|")


_CUES = {
    "phone": {"tel", "phone", "call", "fax", "mobile", "telefon", "téléphone", "teléfono", "tél", "whatsapp"},
    "card": {"card", "visa", "mastercard", "karte", "carte", "tarjeta", "credit", "amex"},
    "email": {"email", "mail", "e-mail", "contact", "correo", "courriel"},
    "ip": {"ip", "host", "server", "address", "adresse"},
}


def _is_ip6(word: str) -> bool:
    if word.count(":") < 2:
        return False
    try:
        return ipaddress.ip_address(word).version == 6
    except ValueError:
        return False


#: Words that stand for signs of an address, in capitals or not.
_SIGNS = frozenset((*(x.decode() for x in _OBFUSCATED), "dot", "(dot)", "[dot]"))


def word_features(words: list[str]) -> list[list[str]]:
    cores = [c.lower() if c.lower() in _SIGNS else c for c in map(strip, words)]
    shapes = [shape(c) for c in cores]
    out = []
    for i, (core, s) in enumerate(zip(cores, shapes, strict=True)):
        digits = [c for c in core if c.isascii() and c.isdigit()]
        n = len(digits)
        f = ["bias", f"s={s[:24]}", f"c={re.sub(r'9+', '9', s)[:24]}", f"d={min(n, 20)}"]
        if n == len(core) and n:
            f.append("all digits")
        if "@" in core:
            f.append("at" if re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s.]+", core) else "odd at")
        if n >= 13 and luhn("".join(digits).encode()):
            f.append("luhn")
        if _is_ip6(core):
            f.append("ip6")
        low = core.lower()
        if low in ("(at)", "[at]", "{at}", "dot", "(dot)", "[dot]"):
            f.append(f"w={low.strip('()[]{}')}")
        for step in (-2, -1, 1, 2):
            j = i + step
            other = shapes[j] if 0 <= j < len(words) else "edge"
            if abs(step) == 1:
                f.append(f"{step}s={other[:16]}")
            near = cores[j].lower().rstrip(":") if 0 <= j < len(words) else ""
            if near in ("(at)", "[at]", "{at}"):
                f.append(f"{step}at")
            if near in ("dot", "(dot)", "[dot]"):
                f.append(f"{step}dot")
            if step < 0:
                f += [f"{step}cue={k}" for k, cues in _CUES.items() if near in cues]
        out.append(f)
    return out


# ------------------------------------------------------- labelled table


@lru_cache(maxsize=1)
def labelled_table(rows: int = 1500, seed: int = 7) -> tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]:
    """The training table: (words, labels), made by rule from formats, with as many rows that only look alike."""
    r = random.Random(seed)

    def d(n: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(n))

    def word() -> str:
        w = "".join(r.choice(("an", "er", "on", "st", "la", "mi", "ü", "é", "ing", "de")) for _ in range(r.randint(1, 4)))
        return r.choice((w, w, w, w.capitalize(), w + ".", w + ","))

    def card() -> str:
        body = r.choice("3456") + d(14)
        return next(body + x for x in "0123456789" if luhn((body + x).encode()))

    def hexes(n: int) -> str:
        return "".join(r.choice("0123456789abcdef") for _ in range(n))

    def host() -> str:
        return f"{r.choice(('mail', 'post', 'web'))}{r.choice(('', d(1)))}.{r.choice(('example', 'site', 'firm'))}.{r.choice(('com', 'org', 'de'))}"

    def positive() -> tuple[str, str]:
        c, k = card(), r.randint(0, 12)
        a, b, e = d(3), d(3), d(4)
        name = r.choice(("ann", "bo.li", "kim", "j.doe")) + r.choice(("", d(2), "." + d(2)))
        return (
            ("email", f"{name}@{host()}"),
            ("email", f"{name} {r.choice(('(at)', '[at]', '{at}'))} {host()}"),
            ("email", f"{name} {r.choice(('(at)', '[at]'))} {r.choice(('example', 'firm'))} {r.choice(('dot', '(dot)', '[dot]'))} com"),
            ("ip", ".".join(str(r.randint(1, 255)) for _ in range(4))),
            ("ip", ":".join(hexes(4) for _ in range(8)) if r.random() < 0.5 else f"2001:db8::{hexes(4)}"),
            ("card", c),
            ("card", " ".join(c[i : i + 4] for i in range(0, 16, 4))),
            ("card", r.choice("./-").join(c[i : i + 4] for i in range(0, 16, 4))),
            ("phone", f"+{r.choice(('1', '44', '49'))} ({a}) {b}-{e}"),
            ("phone", f"({a}) {b}-{e}"),
            ("phone", f"{a}-{b}-{e}"),
            ("phone", f"+{d(2)} {d(3)} {d(7)}"),
            ("phone", f"{a}.{b}.{e}"),
        )[k]

    def negative() -> str:
        k = r.randint(0, 25)
        if k > 19:  # words that end in numbers, and codes
            lone = lambda: word().strip(".,") + r.choice((d(1), d(2), d(3), "-" + d(2), "x" + d(1)))
            return " ".join(lone() for _ in range(r.randint(1, 5))) + r.choice(("", ".", ","))
        if k > 15:  # long numbers that are no card's
            body = r.choice("123456789") + d(r.choice((12, 14, 14, 14, 14, 17)))
            return next(body + x for x in "0123456789" if not luhn((body + x).encode()))
        return (
            f"{r.randint(1, 4)}.{r.randint(0, 9)}.", f"version {r.randint(1, 9)}.", str(r.randint(1900, 2030)),
            f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
            f"{d(2)}:{d(2)}:{d(2)}", f"token = \"{hexes(40)}\"", f"password={hexes(18)}",
            "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), f"{d(1)},{d(3)}.{d(2)}", f"${d(3)}",
            f"({r.randint(1, 9)})", d(r.randint(1, 9)), f"{d(3)} {d(3)}", f"{r.randint(1, 99)}%", f"{r.randint(2, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}",
        )[k]

    table = []
    for i in range(rows):
        words, labels = [], []

        def add(text: str, label: str = "O", words: list = words, labels: list = labels) -> None:
            for j, w in enumerate(text.split(" ")):
                words.append(w)
                labels.append(label if label == "O" else f"{'BI'[j > 0]}-{label}")

        for _ in range(r.randint(1, 3)):
            add(word())
        if i % 2:
            kind, text = positive()
            if r.random() < 0.2:
                add(r.choice(sorted(_CUES[kind])) + r.choice(("", ":")))
            add(text + r.choice(("", "", ".", ",")), kind)
        else:
            add(negative())
        for _ in range(r.randint(1, 3)):
            add(word())
        table.append((tuple(words), tuple(labels)))
    return tuple(table)


# -------------------------------------------------------------- the field


class Field:
    """Weights of a linear-chain conditional random field."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.names, self.weights, self.steps = names, weights, steps

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(LABELS)))
        for i, f in enumerate(word_features(words)):
            known = [self.names[x] for x in f if x in self.names]
            out[i] = self.weights[known].sum(axis=0)
        return out

    def viterbi(self, chains: list[np.ndarray], starts: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """Best labels of each chain; chains of like length are decoded together.  ``starts`` has what each label costs at a chain's begin."""
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(chains)
        at = 0
        while at < len(order):
            longest = len(chains[order[at]]) * 5 // 4 + 4
            last = at
            while last < len(order) and last - at < 2048 and len(chains[order[last]]) <= longest:
                last += 1
            group = order[at:last]
            at = last
            length = np.array([len(chains[i]) for i in group])
            if not length.max():
                continue
            n, t, k = len(group), int(length.max()), len(LABELS)
            e = np.zeros((n, t, k))
            for row, i in enumerate(group):
                e[row, : length[row]] = chains[i]
            back = np.zeros((n, t, k), dtype=np.int8)
            best = e[:, 0] + (_START if starts is None else np.array([starts[i] for i in group]))
            for j in range(1, t):
                paths = best[:, :, None] + self.steps[None]
                back[:, j] = paths.argmax(axis=1)
                best = np.where((j < length)[:, None], paths.max(axis=1) + e[:, j], best)
            label = best.argmax(axis=1)
            path = np.zeros((n, t), dtype=np.int64)
            rows = np.arange(n)
            for j in range(t - 1, -1, -1):
                inside = j < length
                path[inside, j] = label[inside]
                if j:
                    label = np.where(inside, back[rows, j, label], label)
            for row, i in enumerate(group):
                out[i] = path[row, : length[row]]
        return out


#: A chain cannot begin inside of a span.
_START = np.array([-1e4 if x[0] == "I" else 0.0 for x in LABELS])


def _allowed() -> np.ndarray:
    """0 for label steps that can be, a large negative number for I- after anything but its own kind."""
    k = len(LABELS)
    out = np.zeros((k, k))
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            for i, frm in enumerate(LABELS):
                if frm[2:] != to[2:]:
                    out[i, j] = -1e4
    return out


@lru_cache(maxsize=1)
def trained(iterations: int = 120, rate: float = 0.15, ridge: float = 0.002) -> Field:
    """Fit the field to the labelled table by likelihood (forward-backward sums, Adam steps)."""
    table = labelled_table()
    features = [word_features(list(words)) for words, _ in table]
    seen: dict[str, int] = {}
    for rows in features:
        for f in rows:
            for x in f:
                seen[x] = seen.get(x, 0) + 1
    names = {x: i for i, x in enumerate(sorted(x for x, n in seen.items() if n >= 2))}
    n, t, k = len(table), max(len(w) for w, _ in table), len(LABELS)
    length = np.array([len(w) for w, _ in table])
    gold = np.zeros((n, t), dtype=np.int64)
    where, what = [], []
    for i, rows in enumerate(features):
        gold[i, : length[i]] = [LABELS.index(x) for x in table[i][1]]
        for j, f in enumerate(rows):
            for x in f:
                if x in names:
                    where.append(i * t + j)
                    what.append(names[x])
    where, what = np.array(where), np.array(what)
    # sums by place and by feature are those of runs of equal numbers in sorted order
    by_what = np.argsort(what, kind="stable")
    at_place, places = np.unique(where, return_index=True)
    at_feature, runs = np.unique(what[by_what], return_index=True)
    mask = np.arange(t)[None] < length[:, None]
    weights, steps = np.zeros((len(names), k)), np.zeros((k, k))
    banned = _allowed()
    moment = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(steps), np.zeros_like(steps)]
    gold_steps = np.zeros((k, k))
    for j in range(1, t):
        on = mask[:, j]
        np.add.at(gold_steps, (gold[on, j - 1], gold[on, j]), 1)
    one = np.zeros((n * t, k))
    one[np.flatnonzero(mask.ravel()), gold.ravel()[mask.ravel()]] = 1

    for it in range(1, iterations + 1):
        e = np.zeros((n * t, k))
        e[at_place] = np.add.reduceat(weights[what], places)
        e = e.reshape(n, t, k)
        up, move = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(steps + banned)
        # sums over all paths up to a word and from it on, each step brought to sum 1
        ahead, behind, scale = np.empty((n, t, k)), np.ones((n, t, k)), np.ones((n, t, 1))
        for j in range(t):
            ahead[:, j] = (ahead[:, j - 1] @ move if j else np.exp(_START)) * up[:, j]
            scale[:, j] = ahead[:, j].sum(axis=1, keepdims=True)
            ahead[:, j] /= scale[:, j]
            if j:
                off = ~mask[:, j]
                ahead[off, j], scale[off, j] = ahead[off, j - 1], 1
        for j in range(t - 2, -1, -1):
            on = mask[:, j + 1]
            behind[on, j] = (up[on, j + 1] * behind[on, j + 1] / scale[on, j + 1]) @ move.T
        expected = ahead * behind * mask[..., None]
        on = mask[:, 1:, None]
        pairs = np.einsum("ntk,ntl->kl", ahead[:, :-1], up[:, 1:] * behind[:, 1:] / scale[:, 1:] * on, optimize=True)
        expected_steps = pairs * move
        diff = one - expected.reshape(n * t, k)
        slope = np.zeros_like(weights)
        slope[at_feature] = np.add.reduceat(diff[where[by_what]], runs)
        for x, g, m, v in ((weights, slope / n - ridge * weights, moment[0], moment[1]), (steps, (gold_steps - expected_steps) / n - ridge * steps, moment[2], moment[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
    return Field(names, weights, steps + banned)


# ------------------------------------------------------------ the operator


def _joined(chains: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Stretches (first word, end, text) in order, those that meet as one."""
    out: list[tuple[int, int, int]] = []
    for a, b, o in sorted(chains):
        if out and out[-1][2] == o and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), o)
        else:
            out.append((a, b, o))
    return out


def _decoded(block: Block, chains: list[tuple[int, int, int]], field: Field) -> list[np.ndarray]:
    """Best labels of stretches of words, each after a word outside of any span, and with nothing said of the words after it."""
    emissions, starts = [], []
    for a, b, o in chains:
        first, last = int(block.offsets[o]), int(block.offsets[o + 1])
        low, high = max(first, a - 2), min(last, b + 2)  # features look two words to either side
        words = [block.data[block.start[w] : block.end[w]].decode("utf-8", "replace") for w in range(low, high)]
        emissions.append(field.emissions(words)[a - low : b - low])
        starts.append(_START if a == first else field.steps[0])
    return field.viterbi(emissions, starts)


def model_spans(texts: list[bytes], field: Field) -> list[list[tuple[int, int, int]]]:
    """(kind number, start, end) in bytes for each text, by the field."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    block = Block(texts, lower=False)
    if not len(block.start):
        return out
    marked = ((block.bytes >= 48) & (block.bytes <= 57)) | (block.bytes == 64)
    lowered = ascii_lower(block.data)
    for sign in _OBFUSCATED:
        at = lowered.find(sign)
        while at >= 0:
            marked[at] = True
            at = lowered.find(sign, at + 1)
    hits = np.flatnonzero(marked)
    if not len(hits):
        return out
    words = np.unique(np.searchsorted(block.start, hits, "right") - 1)
    owner = np.searchsorted(block.offsets, words, "right") - 1
    low, high = block.offsets[owner], block.offsets[owner + 1]
    begin, end = np.maximum(words - CONTEXT, low), np.minimum(words + CONTEXT + 1, high)
    todo = list(zip(begin.tolist(), end.tolist(), owner.tolist(), strict=True))
    chains: list[tuple[int, int, int]] = []
    paths: list[np.ndarray] = []
    step = 2 * CONTEXT
    while todo:
        todo = _joined(todo)
        found = _decoded(block, todo, field)
        wider = []
        for (a, b, o), path in zip(todo, found, strict=True):
            first, last = int(block.offsets[o]), int(block.offsets[o + 1])
            left, right = a > first and path[:CONTEXT].any(), b < last and path[-CONTEXT:].any()
            if left or right:
                wider.append((max(first, a - step) if left else a, min(last, b + step) if right else b, o))
            else:
                chains.append((a, b, o))
                paths.append(path)
        step *= 2
        # what a wider stretch runs into is decoded with it
        met = [c for c in zip(chains, paths, strict=True) if any(w[2] == c[0][2] and w[0] <= c[0][1] and c[0][0] <= w[1] for w in wider)] if wider else []
        if met:
            gone = {c[0] for c in met}
            wider += gone
            kept = [c for c in zip(chains, paths, strict=True) if c[0] not in gone]
            chains, paths = [c for c, _ in kept], [x for _, x in kept]
        todo = wider
    for (a, _, o), path in zip(chains, paths, strict=True):
        j = 0
        while j < len(path):
            name = LABELS[path[j]]
            if name[0] != "B":
                j += 1
                continue
            last = j + 1
            while last < len(path) and LABELS[path[last]] == "I-" + name[2:]:
                last += 1
            start, end = int(block.start[a + j]), int(block.end[a + last - 1])
            while end > start and block.data[end - 1] in b".,;:!?\"'*#%&$|":
                end -= 1
            while start < end and block.data[start] in b"\"'*#%&$|":
                start += 1
            if end > start:
                base = int(block.doc_start[o])
                out[o].append((KINDS.index(name[2:]), start - base, end - base))
            j = last
    return out


def find_spans(texts: list[bytes], field: Field) -> list[tuple[list, list]]:
    """For each text, its base spans and all its spans, by kind and start, in code points."""
    found = []
    for text, more in zip(texts, model_spans(texts, field), strict=True):
        base = base_spans(text) if more or any(c in text for c in (b"@", b"+")) or re.search(rb"[0-9]", text) else []
        extra = [s for s in more if all(s[2] <= b[1] or b[2] <= s[1] for b in base)]
        spans = sorted(base), sorted(base + extra)
        if spans[1] and not text.isascii():
            at = np.zeros(len(text) + 1, dtype=np.int64)
            np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80, out=at[1:])
            spans = tuple([(k, int(at[a]), int(at[b])) for k, a, b in s] for s in spans)
        found.append(spans)
    return found


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, base, spans`` for each row: the spans of the fixed patterns, and those with the field's own added.

    Spans are (kind, start, end), in code points with the end exclusive, by kind as
    in ``KINDS`` and then by start; a span of the field that touches one of the
    patterns is dropped.  A missing or empty text has none; texts of any length are read
    whole.  Ids are passed on as they are, repeated rows get equal spans, an empty table
    gives an empty result, and other columns are not read.  No shuffle.
    """
    picked = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            found = []
            for _, _, texts in text_blocks(batch.column("text")):
                found += find_spans(texts, field)
            columns = [
                pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in s[i]] for s in found], type=_SPANS)
                for i in range(2)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "base", "spans"])
        release()

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, base {spans}, spans {spans}")


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in brackets; a missing text stays missing.

    Where spans of two kinds overlap, the earlier one is replaced, up to the end of the later.
    Repeated rows are alike, columns of any name are passed on, and an empty table stays empty.
    ``length_col``, if the table has it, is set to the new number of code points.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def cleaned(text: str, spans: list) -> str:
        out, at = [], 0
        for k, a, b in sorted(spans, key=lambda s: (s[1], s[0])):
            if a >= at:
                out += [text[at:a], f"<{KINDS[k].upper()}>"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    place, kind = docs.columns.index(text_col), docs.schema[text_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            column = batch.column(place)
            for first, last, block in text_blocks(column.cast(pa.binary())):
                texts = column.slice(first, last - first)
                found = find_spans(block, field)
                if any(spans for _, spans in found):
                    clean = [cleaned(texts[i].as_py(), spans) if spans else texts[i].as_py() for i, (_, spans) in enumerate(found)]
                    texts = pa.array(clean, column.type)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([texts if i == place else part.column(i) for i in range(part.num_columns)], schema=batch.schema)
        release()

    assert kind.simpleString() == "string", "the text must be a string"
    out = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col).cast(kind)))
    return out
