"""Personal data: base patterns, and a character BiLSTM-CRF that adds spans shaped like them."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, lowest, stored, table, texts_of
from .tagger import KINDS, Tagger, encoded, tags_of

#: Windows of WIDTH code points start every STEP: each place lies in two, once near the middle.
WIDTH, STEP = 96, 48
#: The model trains on at most so many windows of each kind, and of windows without any span: the lowest hashes.
SAMPLE = 1200
#: A span is added where each of its tags has this probability at least.
SURE = 0.3

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}", re.A)
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Every span of the four kinds holds a digit or @; windows without either need no decoding.
_MARK = re.compile("[0-9@]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by the base patterns, by kind, then start; in time linear in the text."""
    found = []
    if "@" in text:
        end = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((0, start, m.end()))
                end = m.end()
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return found


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or @, so that each such place is seen with text on both sides."""
    starts: set[int] = set()
    for m in _MARK.finditer(text):
        k = m.start() // STEP
        starts.update((max(k - 1, 0) * STEP, k * STEP))
    return sorted(starts)


def training_windows(docs: DataFrame) -> DataFrame:
    """(kind, hash, chars, tags): windows with their base labels; spans cut by a window's edge leave the window out."""

    def run(batches):
        schema = pa.schema([("kind", pa.int32()), ("hash", pa.string()), ("chars", pa.binary()), ("tags", pa.binary())])
        for batch in batches:
            rows = []
            for raw in texts_of(batch):
                if not _MARK.search(text := raw.decode()):
                    continue
                spans = sorted(base_spans(text), key=lambda s: s[1])
                starts_at = [s[1] for s in spans]
                for start in window_starts(text):
                    lo = np.searchsorted(starts_at, start - 400)
                    near = []
                    for s in spans[lo:]:
                        if s[1] >= start + WIDTH:
                            break
                        if s[2] > start:
                            near.append((s[0], s[1] - start, s[2] - start))
                    part = text[start : start + WIDTH]
                    if any(a < 0 or b > len(part) for _, a, b in near) or any(x[2] > y[1] for x, y in zip(near, near[1:], strict=False)):
                        continue
                    rows.append((near[0][0] if near else len(KINDS), hashlib.md5(part.encode()).hexdigest(), encoded(part, WIDTH).astype(np.uint8).tobytes(), tags_of(near, WIDTH).astype(np.uint8).tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return bounded(docs).select("text").mapInArrow(run, "kind int, hash string, chars binary, tags binary")


def train(docs: DataFrame, sample: int = SAMPLE, steps: int = 220) -> Tagger | None:
    """A tagger from the base labels of a sample of windows (see SAMPLE); None where there are no labelled spans.

    Training runs in a task, on that bounded sample alone. Each window is also shown with half of its digits
    drawn anew, so that the shape counts and not the number.
    """
    of = training_windows(docs).groupBy("hash").agg(F.min(F.struct("kind", "tags", "chars")).alias("w"))  # equal windows may differ in tags
    windows = stored(of.select("w.kind", "hash", "w.chars", "w.tags"), "windows")
    chosen = None
    for k, n in windows.groupBy("kind").count().collect():
        part = lowest(windows.where(F.col("kind") == k), sample, n, "hash")
        chosen = part if chosen is None else chosen.union(part)

    def fit(batches):
        rows = sorted((x for b in batches for x in b.to_pylist()), key=lambda x: (x["kind"], x["hash"]))
        if not any(r["kind"] < len(KINDS) for r in rows):
            return
        chars = np.stack([np.frombuffer(r["chars"], np.uint8) for r in rows]).astype(np.int64)
        tags = np.stack([np.frombuffer(r["tags"], np.uint8) for r in rows]).astype(np.int64)
        rng = np.random.default_rng(1)
        zero = ord("0") - 32 + 4
        fresh = np.where((chars >= zero) & (chars < zero + 10) & (rng.random(chars.shape) < 0.5), rng.integers(zero, zero + 10, chars.shape), chars)
        model = Tagger().fit(np.concatenate([chars, fresh]), np.concatenate([tags, tags]), steps)
        yield pa.RecordBatch.from_arrays([pa.array(list(model.w)), pa.array([x.astype("<f4").tobytes() for x in model.w.values()], pa.binary())], ["name", "weights"])

    if chosen is None:
        return None
    weights = {r.name: bytes(r.weights) for r in chosen.coalesce(1).mapInArrow(fit, "name string, weights binary").collect()}
    if not weights:
        return None
    model = Tagger()
    model.w = {k: np.frombuffer(weights[k], "<f4").reshape(v.shape) for k, v in model.w.items()}
    return model


def added(texts: list[str], bases: list[list], model: Tagger | None) -> list[list[tuple[int, int, int]]]:
    """For each text the model's spans, reconciled over its windows.

    All spans of all windows of a text compete: those that lie farther from their window's edges come first,
    then the surer, then the earlier; one that meets a base span or an accepted one is dropped, as is one
    that touches an inner edge of its window, which the next window shows whole.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if model is None:
        return out
    jobs = [(i, s) for i, x in enumerate(texts) for s in window_starts(x)]
    rivals: dict[int, list] = {}
    for at in range(0, len(jobs), 2048):
        part = jobs[at : at + 2048]
        chars = np.stack([encoded(texts[i][s : s + WIDTH], WIDTH) for i, s in part])
        for (i, s), spans in zip(part, model.decode(chars), strict=True):
            size = min(WIDTH, len(texts[i]) - s)
            for kind, a, b, sure in spans:
                whole = (a > 0 or s == 0) and (b < size or s + size == len(texts[i]))
                if sure >= SURE and b <= size and b - a >= 7 and whole and _MARK.search(texts[i], s + a, s + b):
                    rivals.setdefault(i, []).append((-min(a, size - b), -sure, s + a, s + b, kind))
    for i, found in rivals.items():
        taken = sorted((a, b) for _, a, b in bases[i])
        for _, _, a, b, kind in sorted(found):
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                out[i].append((kind, a, b))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, n_added, spans for every row of docs (doc_id, text).

    One pass, no shuffle; the model (some 40 KB) travels with the tasks. Null or empty text has no spans.
    Null doc_id and equal rows pass through, row by row. Other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            texts = [x.decode() for x in texts_of(batch)]
            bases = [base_spans(x) if _MARK.search(x) else [] for x in texts]
            more = added(texts, bases, model)
            cols = [pa.array([sum(s[0] == k for s in b) for b in bases], pa.int64()) for k in range(len(KINDS))]
            cols.append(pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in bases], pa.string()))
            cols.append(pa.array([len(m) for m in more], pa.int64()))
            cols.append(pa.array([joined(b + m) for b, m in zip(bases, more, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "n_added", "spans"])

    docs = bounded(docs).select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, n_added long, spans string")


def op10_personal(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs))
