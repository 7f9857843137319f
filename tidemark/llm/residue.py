"""Template residue, filler, error pages and script notices instead of content.

A regularised linear classifier over hashed character n-grams, length, status and
title features decides.  It judges every segment (sentence or line) of a text, and
apart from that every placeholder by its surroundings: does it stand in a value's
place, or is it merely spoken of?  It is trained here, on weak labels from phrases
and status patterns: sentences that hold one are residue, unless they stand within a
longer genuine text; sentences of texts without any are content.  Short segments
that the sample shows in residue and in content alike ("read more") are neutral, as
is a signature, the one line after a line of dashes.

A text is residue if a placeholder stands in a value's place, or if nearly all of it
is.  The phrases take no part in that; the delimiters of placeholders do, as an
exact check that there is one at all.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import residue_rules as rules
from tidemark.llm.residue_rules import HOLE, SIGNED, TITLE

BITS = 18
AROUND = 16  # characters on either side of a placeholder whose n-grams tell its use
CONTEXT = 120  # characters on either side that may speak of labels, brackets or templates
CUT_CHARS = 400  # longer segments are judged piece by piece
STRAY = 0.3  # share of a text's characters that may look like content although the text is residue
SHORT = 40  # characters of segments that can be neutral
NEUTRAL = 0.03  # times a neutral segment stands among residue for each time among content
LABELS_DDL = "kind STRING, item STRING, residue BIGINT, content BIGINT"


def features(segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed feature numbers, start of each segment): 3- to 5-grams of characters and a few counts.

    All segments at once: the n-grams are hashed from their code points with numpy.
    Digits count as one character, but status numbers have a feature of their own.
    """
    texts = [f"\x02{s.lower().removeprefix(SIGNED)}\x03" for s in segments]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    code[(code >= 48) & (code <= 57)] = 48
    owner = np.repeat(np.arange(len(texts)), sizes)
    number, row = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, 6):
        if len(code) < n:
            break
        h = (h[: len(code) - n + 1] ^ code[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n >= 3:
            whole = owner[: len(h)] == owner[n - 1 :]
            number.append(((h[whole] >> np.uint64(20)) & np.uint64(2**BITS - 1)).astype(np.int64) % (2**BITS - 2048))
            row.append(owner[: len(h)][whole])
    words = [rules.WORD.findall(s) for s in texts]
    count = np.fromiter(map(len, words), np.int64, len(words))
    different, keys = np.array([rules.variety(w) if len(w) > 2 else (1.0, 0.0) for w in words]).T
    mark = lambda hits: np.array(hits, bool)
    always = np.ones(len(texts), bool)
    extra = [
        (np.zeros(len(texts), np.int64), always, 1),
        (1 + np.minimum(np.log2(sizes).astype(np.int64), 15), always, 1),
        (20 + np.minimum(count, 15), always, 1),
        (40 + (different * 8).astype(np.int64) + 9 * np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), 5), count > 2, 12),
        (100 + (keys * 4).astype(np.int64), keys > 0, 12),
        (114 + (different * 4).astype(np.int64), count > 3, 12),
        (np.full(len(texts), 110), mark([rules.STATUS_NUMBER.search(s) is not None for s in segments]), 12),
        (np.full(len(texts), 111), mark([HOLE in s for s in segments]), 12),
        (np.full(len(texts), 112), mark(['""' in s for s in segments]), 12),
        (np.full(len(texts), 113), mark([TITLE in s for s in segments]), 12),
    ]
    for value, there, copies in extra:
        for copy in range(copies):  # marks weigh as much as a dozen n-grams
            number.append(2**BITS - 2048 + value[there] + 128 * copy)
            row.append(np.flatnonzero(there))
    number, row = np.concatenate(number), np.concatenate(row)
    pair = np.sort(row << BITS | number)
    pair = pair[np.append(True, pair[1:] != pair[:-1])]  # a feature counts once, however often it occurs
    return pair & (2**BITS - 1), np.searchsorted(pair >> BITS, np.arange(len(texts)))


def slots(segment: str) -> list[str]:
    """Surroundings of each placeholder of a segment: close by, and what is said further off."""
    out, at = [], segment.find(HOLE)
    while at >= 0:
        close = segment[max(0, at - AROUND) : at + AROUND + 1]
        out.append(close + "\x03" + segment[max(0, at - CONTEXT) : at].replace(HOLE, "\x04") + "\x05" + segment[at + 1 : at + CONTEXT].replace(HOLE, "\x04"))
        at = segment.find(HOLE, at + 1)
    return out


def fit(number: np.ndarray, start: np.ndarray, label: np.ndarray, weight: np.ndarray, *, l2: float = 1e-6, steps: int = 120, rate: float = 0.7, w: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression with an L2 penalty (Adagrad over all rows, deterministic), from ``w`` on if given."""
    size = np.diff(np.append(start, len(number)))
    scale = 1 / np.sqrt(np.maximum(size, 1))  # each row has length one
    used, number = np.unique(number, return_inverse=True)
    all_of = np.zeros(2**BITS) if w is None else w.astype(np.float64)
    now, seen = all_of[used], np.full(len(used), 1e-8)
    total = weight.sum()
    for _ in range(steps):
        z = np.add.reduceat(now[number], start) * scale
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.bincount(number, weights=np.repeat((p - label) * weight * scale / total, size), minlength=len(used)) + l2 * now
        seen += g * g
        now -= rate * g / np.sqrt(seen)
    all_of[used] = now
    return all_of.astype(np.float32)


def score(w: np.ndarray, segments: list[str]) -> np.ndarray:
    """Probability of residue for each segment."""
    out = np.empty(len(segments))
    for lo in range(0, len(segments), 4096):
        number, start = features(segments[lo : lo + 4096])
        size = np.diff(np.append(start, len(number)))
        z = np.add.reduceat(w[number].astype(np.float64), start) / np.sqrt(np.maximum(size, 1))
        out[lo : lo + 4096] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def weak_labels(texts: list[str | None]) -> dict[tuple[str, str], list[int]]:
    """(kind, item) -> [times residue, times content].  kind: segment, slot, or context of a short segment without a phrase."""
    seen: dict[tuple[str, str], list[int]] = {}

    def note(kind: str, item: str, residue: bool) -> None:
        seen.setdefault((kind, item), [0, 0])[0 if residue else 1] += 1

    for text in texts:
        parts = [s for s in rules.split(text) if not s.startswith(SIGNED) or HOLE in s]
        if not parts:
            continue
        whole = rules.filler(rules.WORD.findall(" ".join(parts).lower()))
        said = [whole or rules.kind_of(s) != "text" for s in parts]
        plain = len(said) - sum(said)
        named = sum(len(s) for s, phrase in zip(parts, said) if phrase)
        among = 2 * named > sum(map(len, parts))
        for segment, phrase in zip(parts, said):
            for slot in slots(segment):
                note("slot", slot, not (rules.MENTION.search(segment) or rules.ADJECTIVE.search(slot)))
            if HOLE in segment and not phrase:
                continue
            for piece in rules.pieces(segment, CUT_CHARS):
                if phrase and (not plain or plain >= 3):
                    note("segment", piece, not plain)
                elif not phrase and 2 * sum(said) < len(said):
                    note("segment", piece, False)
                # else unsure: a strange sentence among residue, a phrase beside one or two other sentences
            if not phrase and len(segment) <= SHORT:
                note("context", rules.normal(segment), among)
    return seen


@dataclass
class Model:
    """Weights of both classifiers, and the segments that say nothing either way."""

    segment: np.ndarray
    slot: np.ndarray
    neutral: frozenset[str] = field(default_factory=frozenset)

    def save(self, spark: SparkSession, path: str) -> None:
        """Keep the weights in a folder, one row each, for later runs."""
        rows = [(k, w.tobytes(), None) for k, w in (("segment", self.segment), ("slot", self.slot))] + [("neutral", None, json.dumps(sorted(self.neutral)))]
        spark.createDataFrame(rows, "part STRING, weights BINARY, words STRING").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        rows = {r.part: r for r in spark.read.parquet(path).collect()}
        w = {k: np.frombuffer(bytes(rows[k].weights), np.float32) for k in ("segment", "slot")}
        return Model(w["segment"], w["slot"], frozenset(json.loads(rows["neutral"].words)))


def _fit_one(label: dict[str, list[int]], most_content: int) -> np.ndarray:
    """Fit on all residue and ``most_content`` content items, then again with the content items that came out wrong."""
    items = sorted(label)
    y = np.array([label[s][0] > label[s][1] for s in items])
    times = np.array([sum(label[s]) for s in items])
    content = np.flatnonzero(~y)
    few = content[:: max(1, -(-len(content) // most_content))]
    w, used = None, np.union1d(np.flatnonzero(y), few)
    for _ in range(3):
        balance = max(1.0, min(4.0, (~y[used]).sum() / max(y[used].sum(), 1)))
        weight = (1 + np.log2(times[used])) * np.where(y[used], balance, 1.0)
        w = fit(*features([items[k] for k in used]), y[used].astype(float), weight, w=w, steps=120 if w is None else 40)
        rest = np.setdiff1d(content, used)
        wrong = rest[score(w, [items[k] for k in rest]) > 0.25]
        if not len(wrong):
            break
        used = np.union1d(used, wrong)
    return w


def _spread(segment: dict[str, list[int]], rounds: int = 3) -> None:
    """Weak labels go on to segments made of words that occur in residue mostly, as in filler without a known word."""
    words = {s: rules.WORD.findall(s.lower()) for s in segment}
    for _ in range(rounds):
        seen: dict[str, list[int]] = {}
        for s, n in segment.items():
            for x in set(words[s]):
                seen.setdefault(x, [0, 0])[n[0] <= n[1]] += 1
        ours = {x for x, (r, c) in seen.items() if r >= 2 and r > c}
        more = [s for s, n in segment.items() if n[0] <= n[1] and len(words[s]) > 2 and sum(x in ours for x in words[s]) >= 0.7 * len(words[s])]
        if not more:
            return
        for s in more:
            segment[s] = [max(segment[s]), 0]


def train(labels: dict[tuple[str, str], list[int]], *, most_content: int = 12_000) -> Model:
    """Both classifiers from weak labels.  Without any label the phrases alone are known."""
    kinds: dict[str, dict[str, list[int]]] = {"segment": {}, "slot": {}, "context": {}}
    for (kind, item), (residue, content) in labels.items():
        kinds[kind][item] = [residue, content]
    neutral = frozenset(s for s, (r, c) in kinds["context"].items() if r >= 3 and r >= NEUTRAL * c and c)
    segment = {s: n for s, n in kinds["segment"].items() if rules.normal(s) not in neutral and n[0] != n[1]}
    for s, (residue, content) in kinds["context"].items():
        if residue >= 3 and not content:  # never seen but among residue
            segment[s] = [residue, 0]
    _spread(segment)
    for phrase in rules.seeds():
        segment.setdefault(phrase, [1, 0])
    segment.setdefault("ok", [0, 1])
    slot = {s: n for s, n in kinds["slot"].items() if n[0] != n[1]}
    for s in slots(f"the {HOLE} is good") + slots(HOLE):
        slot.setdefault(s, [1, 0])
    for s in slots(f"the template on the label says {HOLE}") + slots(f"the {HOLE} shape of it"):
        slot.setdefault(s, [0, 1])
    return Model(_fit_one(segment, most_content), _fit_one(slot, most_content), neutral)


def fit_model(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id", sample_rows: int = 10_000, sample_items: int = 60_000) -> Model:
    """Train on about ``sample_rows`` texts, labelled where they lie; the bounds are of the training sample only.

    Rows are taken by the hash of their id.  At most ``sample_items`` different
    segments of at most 400 characters come to the driver, residue first.
    """
    share = min(1.0, sample_rows / max(docs.count(), 1))
    mark = F.pmod(F.xxhash64(F.lit("residue"), F.col(id_column)), F.lit(1_000_000))
    rows = docs.select(F.col(text).cast("string").alias("t"), mark.alias("h")).where((F.col("h") < int(share * 1_000_000)) & F.col("t").isNotNull()).select("t")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = weak_labels(batch.column(0).to_pylist())
            columns = [[k for k, _ in seen], [s for _, s in seen], [n[0] for n in seen.values()], [n[1] for n in seen.values()]]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["kind", "item", "residue", "content"])

    per = rows.mapInArrow(kernel, LABELS_DDL).groupBy("kind", "item").agg(F.sum("residue").alias("residue"), F.sum("content").alias("content"))
    few = per.orderBy((F.col("residue") == 0).cast("int"), F.xxhash64("kind", "item"), "item").limit(sample_items).toArrow()
    return train({(k, s): [r, c] for k, s, r, c in zip(*(few.column(n).to_pylist() for n in ("kind", "item", "residue", "content")))})


class Judge:
    """Classifier with a bounded memory of segment scores; one per Python worker."""

    def __init__(self, model: Model, residue_at: float = 0.5, slot_at: float = 0.5):
        self.model, self.at, self.slot_at = model, residue_at, slot_at
        self.known: dict[str, float | None] = {}  # None for neutral segments
        self.known_slots: dict[str, float | None] = {}

    def _scores(self, w: np.ndarray, known: dict[str, float | None], items: set[str], neutral: frozenset[str] = frozenset()) -> None:
        fresh = [s for s in items if s not in known]
        known.update(zip(fresh, score(w, fresh).tolist()))
        if neutral:
            known.update(dict.fromkeys(s for s in fresh if len(s) <= SHORT and rules.normal(s) in neutral))

    def verdicts(self, texts: list[str | None]) -> list[tuple[float, bool]]:
        """(score, found) of each text."""
        split = [rules.split(t) for t in texts]
        holes = [[x for s in parts if HOLE in s for x in slots(s)] for parts in split]
        cut = [[p for s in parts for p in rules.pieces(s, CUT_CHARS)] for parts in split]
        self._scores(self.model.segment, self.known, {p for parts in cut for p in parts}, self.model.neutral)
        self._scores(self.model.slot, self.known_slots, {x for some in holes for x in some})
        out = []
        for parts, some in zip(cut, holes):
            slot = max((self.known_slots[x] for x in some), default=0.0)
            # a signature that reads like content does not make content of what it signs
            rated = [(q, len(p)) for p in parts if (q := self.known[p]) is not None and (q >= self.at or p[0] != SIGNED)]
            size = sum(n for _, n in rated)
            mean = sum(q * n for q, n in rated) / size if size else 0.0
            stray = sum(n for q, n in rated if q < self.at) / size if size else 1.0
            out.append((max(slot, mean), slot >= self.slot_at or (mean >= self.at and stray <= STRAY)))
        for known in (self.known, self.known_slots):
            if len(known) > 100_000:
                known.clear()
        return out


def judge_texts(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id", model: Model | None = None, sample_rows: int = 10_000, residue_at: float = 0.5) -> DataFrame:
    """``<id_column>, score, found`` for every row.

    Null, empty and blank texts are not found (score 0), nor are markup, broken
    encoding or special-token strings by themselves.  Whole texts are judged.
    Without a ``model`` (see ``fit_model``, ``Model.load``) one is fitted on about
    ``sample_rows`` of the texts; without any text it knows the phrases alone.
    """
    fitted = model or fit_model(docs, text=text, id_column=id_column, sample_rows=sample_rows)
    sent = docs.sparkSession.sparkContext.broadcast(fitted)  # 2 MB
    kind = docs.schema[id_column].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(sent.value, residue_at)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                verdicts = judge.verdicts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([v[0] for v in verdicts], pa.float64()), pa.array([v[1] for v in verdicts], pa.bool_())],
                    names=[id_column, "score", "found"],
                )

    return docs.select(id_column, F.col(text).cast("string").alias("text")).mapInArrow(kernel, f"{id_column} {kind}, score DOUBLE, found BOOLEAN")


def held_out(docs: DataFrame, by: str, *, id_column: str = "doc_id", reference: DataFrame | None = None, sample_rows: int = 10_000) -> list[tuple[str, int, int, int]]:
    """For each value of ``by``: (value, weakly labelled or known residue, found, both), judged by a model that has not seen the value's rows.

    ``reference`` (ids of residue) stands for the weak labels where it is known.  Nulls of ``by`` are a value of their own.
    """
    out = []
    for (value,) in sorted(docs.select(by).distinct().collect(), key=str):
        mine = F.col(by).eqNullSafe(F.lit(value))
        model = fit_model(docs.where(~mine), id_column=id_column, sample_rows=sample_rows)
        found = judge_texts(docs.where(mine), id_column=id_column, model=model).where("found").select(id_column)
        known = docs.where(mine).select(id_column).join(reference, id_column) if reference is not None else judge_by_phrases(docs.where(mine), id_column=id_column)
        out.append((value, known.count(), found.count(), known.join(found, id_column).count()))
    return out


def judge_by_phrases(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Ids of the texts that consist of weakly labelled residue or hold a placeholder: what validation compares with."""
    kind = docs.schema[id_column].dataType.simpleString()

    def found(t: str | None) -> bool:
        seen = weak_labels([t])
        marked = [n for (k, _), n in seen.items() if k != "context"]
        return any(k == "slot" and n[0] for (k, _), n in seen.items()) or (bool(marked) and all(n[0] and not n[1] for n in marked))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([found(t) for t in batch.column(1).to_pylist()], pa.bool_())).select([0])

    return docs.select(id_column, F.col(text).cast("string").alias("text")).mapInArrow(kernel, f"{id_column} {kind}")
