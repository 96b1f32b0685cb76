"""Personal data in texts: spans by rules, and more by a bidirectional LSTM with CRF transitions.

Four rules give the base spans: mail and network addresses, card numbers (Luhn), phone numbers.
Stretches of text around digits and @ signs are cut out with their base spans; they are the labelled
spans that the network learns from, beside rewritten and joined forms of them that rules miss (a
phone number before a card number is one failing match to the rules).  Each sign gets a tag: outside,
or first or further sign of a kind.

Every stretch that could hold a span (an @ or four digits) is read in overlapping windows.  A sign's
scores are the mean over its windows, weighted by the distance from a window's ends, and one best
path through the CRF is taken over the whole stretch, so spans don't break at a window's end.  A span
of the network is added if its tags have a mean chance of ``CHANCE``, it overlaps no base span, and
the digits in it fit its kind.  No text is shuffled, and stretches alone are stored.

Fitted on at most ``SAMPLE`` distinct stretches of each kind and of none, a documented bound;
everything else covers all texts.

Defined results: null and empty texts have no spans; whole texts of any length are read, the rules in
linear time; stretches without end (a text of digits) are read in sections of ``SECTION`` signs that
share ``2 * WINDOW`` of them; rows without a doc_id or with a repeated one have results of their own;
of equal chances the lesser tag is taken; without any base span nothing is learned or added; an empty
table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm import tagger
from themeloom.llm.tables import documents, keyed_texts, query, remainder
from themeloom.session import materialize

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, MARGIN = 96, 48, 24
SECTION = 1 << 16
SAMPLE = 400
EPOCHS = 24
CHANCE = 0.9

# The rules, each leftmost and non-overlapping.  What can't change a match is added to
# keep them linear: numbers start where no digit is before them, and nothing once taken is given back.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_TRIGGER = re.compile("[0-9@]")
_NOT_DIGIT = re.compile("[^0-9]+")
# Digits that a span of each kind can have; a mail address has an @ instead.
_DIGITS = {"ip": (4, 12), "card": (16, 19), "phone": (8, 15)}

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            last = domain.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Base spans (kind, start, end), kinds as listed, and matches that failed their test."""
    spans, failed = [(0, s, e) for s, e in _emails(text)], []
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        good = all(len(p) < 4 and int(p or "0") <= 255 for p in parts)
        (spans.append((1, *m.span())) if good else failed.append(m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if len(digits) > 15:
            good = len(digits) < 20 and luhn(digits)
            (spans.append((2, *m.span())) if good else failed.append(m.span()))
    for m in _PHONE.finditer(text):
        good = 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15
        (spans.append((3, *m.span())) if good else failed.append(m.span()))
    return spans, failed


def stretches(text: str) -> list[tuple[int, int]]:
    """Merged surroundings of all digits and @ signs that could hold a span."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        at = m.start()
        if out and at - MARGIN <= out[-1][1]:
            out[-1][1] = at + MARGIN + 1
        else:
            out.append([max(at - MARGIN, 0), at + MARGIN + 1])
    found = []
    for start, end in out:
        end = min(end, len(text))
        part = text[start:end]
        if "@" in part or sum(map(part.count, "0123456789")) >= 4:
            step = SECTION - 2 * WINDOW
            found += [(s, min(s + SECTION, end)) for s in range(start, max(end - 2 * WINDOW, start + 1),
                                                                step)]
    return found


_SPAN = "kind int, start int, end int"
_FOUND = (f"doc_id long, base array<struct<{_SPAN.replace(' int', ':int')}>>, "
          "zones array<struct<start:int,text:string,clear:boolean>>")
_SPAN_TYPE = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_ZONE_TYPE = pa.struct([("start", pa.int32()), ("text", pa.string()), ("clear", pa.bool_())])


def rules(docs: DataFrame) -> DataFrame:
    """(doc_id, base, zones) of every row: base spans, and stretches for the network.

    A stretch is ``clear`` if no rule's match in it failed.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, zones = [], []
            for text in batch.column("text"):
                text = text.as_py()
                spans, cut = [], []
                if _TRIGGER.search(text):
                    spans, failed = base_spans(text)
                    for s, e in stretches(text):
                        clear = not any(a < e and b > s for a, b in failed)
                        cut.append({"start": s, "text": text[s:e], "clear": clear})
                bases.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                zones.append(cut)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(bases, pa.list_(_SPAN_TYPE)),
                 pa.array(zones, pa.list_(_ZONE_TYPE))], names=["doc_id", "base", "zones"])

    return keyed_texts(docs).mapInArrow(scan, _FOUND)


# Signs: each ASCII one by itself, but one symbol for all lower-case letters, capitals and digits.
_PAD, _OTHER = 0, 4
_SYMBOL = np.full(129, _OTHER, dtype=np.uint8)
for _i in range(128):
    _SYMBOL[_i] = (1 if chr(_i).isdigit() else 2 if chr(_i).islower() else 3 if chr(_i).isupper()
                   else 5 + sum(not chr(j).isalnum() for j in range(_i)))
SYMBOLS = int(_SYMBOL.max()) + 1
TAGS = 1 + 2 * len(KINDS)


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _SYMBOL[np.minimum(points, 128)]


def windows(length: int) -> range:
    """Starts of the windows over a stretch."""
    return range(0, max(length - WINDOW, 0) + STRIDE, STRIDE) if length > WINDOW else range(1)


def _window_rows(marks: np.ndarray) -> np.ndarray:
    starts = windows(len(marks))
    padded = np.concatenate([marks, np.zeros(WINDOW, marks.dtype)])
    return np.stack([padded[s:s + WINDOW] for s in starts])


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(length, np.int8)
    for kind, start, end in reversed(spans):
        out[start:end] = 2 + 2 * kind
        out[start] = 1 + 2 * kind
    return out


def _join(pieces: list[tuple[str, int | None]]) -> tuple[str, list[Span]]:
    text, spans = "", []
    for piece, kind in pieces:
        if kind is not None:
            spans.append((kind, len(text), len(text) + len(piece)))
        text += piece
    return text, spans


def rewritten(kind: int, span: str, draw: np.random.Generator) -> str:
    """The span with other digits, sometimes in a form that no rule takes."""
    span = re.sub("[0-9]", lambda _: str(draw.integers(10)), span)
    if kind == 0:
        return span.replace("@", " @ ") if draw.random() < 0.15 else span
    if kind == 1:
        return span.replace(".", ". ") if draw.random() < 0.15 else span
    digits = _NOT_DIGIT.sub("", span)
    if kind == 2:
        mark = draw.choice(["", "", " ", "-", ".", "/"])
        return mark.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    if len(digits) < 10 or draw.random() < 0.6:
        return span
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return str(draw.choice([f"({a}) {b}-{c}", f"+1 ({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"]))


def examples(zones: list[tuple[str, list[Span]]], seed: int = 42) -> tuple[np.ndarray, ...]:
    """Windows (symbols, tags, inside) of labelled stretches and of forms put together from them."""
    draw = np.random.default_rng(seed)
    pool: list[list[str]] = [[] for _ in KINDS]
    for text, spans in zones:
        for kind, start, end in spans:
            pool[kind].append(text[start:end])
    more = []
    for text, spans in zones:
        first = min((s for _, s, _ in spans), default=len(text))
        last = max((e for _, _, e in spans), default=0)
        if not spans or first < 2 or last > len(text) - 2:
            continue
        pieces: list[tuple[str, int | None]] = [(text[:first], None)]
        kinds = [k for k in range(len(KINDS)) if pool[k]]
        for i in range(int(draw.integers(1, 4))):
            kind = int(draw.choice(kinds))
            if i:
                pieces.append((str(draw.choice([" ", ", ", " / ", ": "])), None))
            span = pool[kind][int(draw.integers(len(pool[kind])))]
            pieces.append((rewritten(kind, span, draw), kind))
        more.append(_join([*pieces, (text[last:], None)]))
    rows = [[], [], []]
    for text, spans in [*zones, *more]:
        marks = symbols(text)
        rows[0].append(_window_rows(marks))
        rows[1].append(_window_rows(tags_of(len(marks), spans)))
        rows[2].append(_window_rows(np.ones(len(marks), bool)))
    x, y, inside = (np.concatenate(r) for r in rows)
    # A window may begin inside a span; its first tag is then that of a beginning.
    begins = (y[:, 0] > 0) & (y[:, 0] % 2 == 0)
    y[begins, 0] -= 1
    return x, y, inside


def learn(found: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> bytes | None:
    """Weights of a network fitted on at most ``sample`` stretches of each kind and of none."""
    zone = found.select("base", F.explode("zones").alias("z")).filter("z.clear").select(
        F.col("z.text").alias("text"), F.transform(
            F.filter("base", lambda b: (b["start"] >= F.col("z.start")) & (
                b["end"] <= F.col("z.start") + F.length("z.text"))),
            lambda b: F.struct(b["kind"].alias("kind"),
                               (b["start"] - F.col("z.start")).alias("start"),
                               (b["end"] - F.col("z.start")).alias("end"))).alias("spans"))
    zone = zone.filter(F.length("text") <= 8 * WINDOW).groupBy("text").agg(
        F.min("spans").alias("spans"))
    rarest = F.coalesce(F.array_max(F.transform("spans", lambda s: s["kind"])), F.lit(-1))
    zone = materialize(zone.select("text", "spans", rarest.alias("kind"),
                                   F.xxhash64("text").alias("h")))
    counts = {r["kind"]: r["count"] for r in zone.groupBy("kind").count().collect()}
    if not set(counts) - {-1}:
        return None
    share = F.lit(0)
    for kind, count in counts.items():
        kept = min(1.0, 2 * sample / count)
        share = F.when(F.col("kind") == kind, int(kept * (1 << 20))).otherwise(share)
    some = zone.filter(F.pmod("h", F.lit(1 << 20)) < share)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["h"], r["text"]))
        taken = [r for k in sorted(counts) for r in [r for r in rows if r["kind"] == k][:sample]]
        zones = [(r["text"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in taken]
        if any(spans for _, spans in zones):
            w = tagger.initial(SYMBOLS, TAGS)
            for _ in tagger.train(w, *examples(zones), epochs):
                pass
            yield pa.RecordBatch.from_arrays([pa.array([tagger.pack(w)], pa.binary())], names=["w"])

    got = some.repartition(1).mapInArrow(fit, "w binary").collect()
    return bytes(got[0].w) if got else None


def network_spans(w: tagger.Weights, texts: list[str], chance: float = CHANCE
                  ) -> list[list[Span]]:
    """Spans of each stretch that the network finds with a mean chance of at least ``chance``."""
    marks = [symbols(t) for t in texts]
    steps = w["trans"] + tagger.barred(TAGS)
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
    out: list[list[Span]] = [[] for _ in texts]
    order = sorted(range(len(texts)), key=lambda i: len(marks[i]))
    at = 0
    while at < len(order):
        # rows of about as many signs as a few hundred windows hold
        take = max(1, 256 * WINDOW // max(len(marks[order[min(at + 255, len(order) - 1)]]), WINDOW))
        group = order[at:at + take]
        at += take
        longest = max(len(marks[i]) for i in group)
        em = np.zeros((len(group), longest, TAGS), np.float32)
        inside = np.zeros((len(group), longest), bool)
        cuts = [(r, s) for r, i in enumerate(group) for s in windows(len(marks[i]))]
        rows = np.concatenate([_window_rows(marks[i]) for i in group])
        weights = np.zeros((len(group), longest, 1), np.float32)
        for first in range(0, len(rows), 512):
            scores = tagger.emissions(w, rows[first:first + 512])
            for (r, s), e in zip(cuts[first:first + 512], scores, strict=True):
                n = min(WINDOW, len(marks[group[r]]) - s)
                em[r, s:s + n] += e[:n] * weight[:n, None]
                weights[r, s:s + n, 0] += weight[:n]
        for r, i in enumerate(group):
            inside[r, :len(marks[i])] = True
        em /= np.maximum(weights, 1e-9)
        tags = tagger.decode(em, steps, inside)
        _, chances, _ = tagger.marginals(em, steps, inside)
        own = np.take_along_axis(chances, tags[:, :, None].astype(np.int64), 2)[:, :, 0]
        for r, i in enumerate(group):
            for start in np.flatnonzero(tags[r] % 2 == 1).tolist():
                tag, end = int(tags[r, start]), start + 1
                while end < longest and tags[r, end] == tag + 1:
                    end += 1
                if own[r, start:end].mean() >= chance:
                    out[i].append(((tag - 1) // 2, start, end))
    return out


def fits(kind: int, span: str) -> bool:
    """Whether a span of the network can be of its kind."""
    if KINDS[kind] == "email":
        return span.count("@") == 1 and "." in span.split("@")[1]
    digits = _NOT_DIGIT.sub("", span)
    low, high = _DIGITS[KINDS[kind]]
    return low <= len(digits) <= high and (KINDS[kind] != "card" or luhn(digits))


def all_spans(w: tagger.Weights | None, rows: list[dict], chance: float = CHANCE
              ) -> list[list[Span]]:
    """Base spans of each row and those that the network adds, by kind and start."""
    base = [[(b["kind"], b["start"], b["end"]) for b in r["base"]] for r in rows]
    if w is None:
        return base
    zones = [(i, z) for i, r in enumerate(rows) for z in r["zones"]]
    added: list[set[Span]] = [set() for _ in rows]
    spans = network_spans(w, [z["text"] for _, z in zones], chance) if zones else []
    for (i, z), found in zip(zones, spans, strict=True):
        for kind, s, e in found:
            text = z["text"][s:e]
            s, e = s + len(text) - len(text.lstrip()), e - len(text) + len(text.rstrip())
            start, end = z["start"] + s, z["start"] + e
            taken = any(a < end and b > start for _, a, b in base[i])
            if not taken and s < e and fits(kind, z["text"][s:e]):
                added[i].add((kind, start, end))
    out = []
    for mine, more in zip(base, added, strict=True):
        last = -1
        for kind, s, e in sorted(more, key=lambda x: (x[1], -x[2])):
            if s >= last:
                mine = [*mine, (kind, s, e)]
                last = e
        out.append(sorted(mine))
    return out


def personal_data(docs: DataFrame, train: Column | None = None, sample: int = SAMPLE,
                  epochs: int = EPOCHS, chance: float = CHANCE) -> DataFrame:
    """(doc_id, base, spans) of every row: arrays of (kind, start, end), kinds as in ``KINDS``.

    Learns from the rows for which ``train`` holds.
    """
    found = materialize(rules(docs))
    packed = learn(found if train is None else found.filter(train), sample, epochs)
    kind = "array<struct<kind:int,start:int,end:int>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = tagger.unpack(packed) if packed else None
        for batch in batches:
            spans = all_spans(w, batch.select(["base", "zones"]).to_pylist(), chance)
            dicts = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in row]
                     for row in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("base"),
                 pa.array(dicts, pa.list_(_SPAN_TYPE))], names=["doc_id", "base", "spans"])

    return found.mapInArrow(scan, f"doc_id long, base {kind}, spans {kind}")


def listed(spans: str) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long")


@query
def op13_personal_data(spark, sf_dir):
    """Personal data in every document; a fifth of the ids doesn't train."""
    trains = F.coalesce(remainder(F.col("doc_id"), 5) != 0, F.lit(False))
    found = personal_data(documents(spark, sf_dir), trains)
    return found.select(
        "doc_id", *[_count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
