"""Quality classifier by co-training of two views.

The *content* view is logistic regression over hashed words (as written, and the shape
of each) and over the form of the text (lines, words, symbols, letters).  The *metadata*
view is one over what is known beside the text: language, source, both together, and
the recorded length.  Each learns from labelled documents.  In every round each view
scores all unlabelled documents; of those that its calibrated score is ``SURE`` of, a
bounded number, by hash, of either kind goes to the other view with that label.  Both
views are calibrated on labelled documents that no training saw (Platt), and a
document's score combines them: the calibrated log odds weighed by a regression on
those holdouts.  Documents that score below ``CUTOFF`` are rejected.

What is fitted is bounded: at most ``LABELLED`` labelled documents, those with the
smallest hashes, and ``HANDED`` of either kind that a view hands over in a round, so
the driver holds no more at any size.  All else covers all documents: features are
extracted once, whole, into the shared folder; means and spreads of the form come from
all of them, and each round scores all of them by a map without a shuffle.  Only ids,
hashes and scores are shuffled, to leave out the labelled ones.

Null and empty texts have no words and are scored by their metadata; null language,
source or length is a value of its own; conflicting labels of a document are averaged,
ties count as good; without labels of both kinds nothing is rejected (score null).
Repeated rows are scored alike.  An empty table gives no rows.  Further columns stay as
they are, whatever they are called; ``quality_score__`` and ``kept__`` get longer names
where they clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from folioscope.llm.scratch import materialize, unused
from folioscope.llm.words import Text, distinct, slices

#: Labelled documents that training takes at most, and documents of either kind that a view hands over in a round.
LABELLED, HANDED = 6000, 300
#: Share of the labelled ones that calibrate.
HOLDOUT = 0.3
#: Rounds, and the calibrated score from which on a view is sure (or below one minus it).
ROUNDS, SURE = 3, 0.97
CUTOFF = 0.5
#: Hashed features of the content view, and of names in the metadata view.
CONTENT, NAMES = 1 << 14, 256
_LAYOUT = 12
#: Columns of the metadata view; names are hashed, numbers are put into classes of their logarithm.
METADATA = ("lang", "source", "n_chars")


def content(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) of the content view; values of a document have unit length."""
    words = text.word_hashes()
    last = text.buf[np.maximum(text.ends - 1, 0)].astype(np.uint64)
    head = text.buf[text.starts].astype(np.uint64) if len(text.starts) else last
    shape = (head * np.uint64(257) + last) * np.uint64(0x9E3779B97F4A7C15)
    half = np.uint64(64 - (CONTENT // 2).bit_length() + 1)
    feature = np.concatenate([(words >> half).astype(np.int64), (shape >> half).astype(np.int64) + CONTENT // 2])
    key = np.tile(text.doc, 2) * CONTENT + feature
    if text.n <= 64:  # a table of all cells is quicker than sorting
        table = np.bincount(key, minlength=text.n * CONTENT)
        keys = np.flatnonzero(table)
        counts = table[keys]
    else:
        keys, counts = np.unique(key, return_counts=True)
    doc, value = keys // CONTENT, np.log1p(counts)
    length = np.sqrt(np.bincount(doc, weights=value * value, minlength=text.n))
    return doc, keys % CONTENT, value / length[doc]


def layout(text: Text) -> np.ndarray:
    """Measures of each document's form: documents x _LAYOUT."""
    words, chars = text.counts, text.word_chars()
    buf = text.buf
    per = [text.per_doc(m) for m in (buf == 0x0A, (buf >= 0x41) & (buf <= 0x5A), (buf >= 0x61) & (buf <= 0x7A), (buf >= 0x30) & (buf <= 0x39), (buf == 0x2E) | (buf == 0x2C), (buf == 0x21) | (buf == 0x3F))]
    kinds = np.bincount(distinct(text.doc, text.word_hashes())[0], minlength=text.n)
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    out = [np.log1p(words), np.log1p(chars), chars / w, per[0] / w, per[1] / c, per[2] / c, per[3] / c, per[4] / w, per[5] / w, text.symbols() / w, kinds / w, np.log1p(per[0])]
    return np.stack(out, axis=1)


def _name_slots(values: pa.Array, seed: int) -> np.ndarray:
    """A slot for each value: of a name by hash, of a number by its logarithm, two classes to a doubling."""
    import xxhash

    def name(v) -> bytes:
        if v is None:
            return b""
        return b"n%d" % int(2 * np.log2(1 + abs(v))) if isinstance(v, (int, float)) and v == v else b"v" + str(v).encode()

    known: dict = {}
    return np.array([known[v] if v in known else known.setdefault(v, xxhash.xxh64_intdigest(name(v), seed) % NAMES) for v in values.to_pylist()], np.int64)


class Model:
    """Weights of one view: ``bias`` and a vector; ``scale`` standardises dense features."""

    def __init__(self, size: int):
        self.w, self.bias = np.zeros(size), 0.0


def _fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, n: int, size: int, l2: float, steps: int = 80) -> Model:
    """Logistic regression on sparse rows by accelerated gradient steps; classes weigh alike."""
    model = Model(size)
    weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
    length = np.bincount(rows, weights=values * values, minlength=n).max(initial=1.0)
    step = 1.0 / (0.25 * (length + 1) + l2)
    w, b, vw, vb = model.w, 0.0, model.w.copy(), 0.0
    for k in range(steps):
        margin = np.bincount(rows, weights=values * vw[cols], minlength=n) + vb
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * weight
        new_w = vw - step * (np.bincount(cols, weights=values * error[rows], minlength=size) + l2 * vw)
        new_b = vb - step * error.sum()
        pace = k / (k + 3)
        vw, vb = new_w + pace * (new_w - w), new_b + pace * (new_b - b)
        w, b = new_w, new_b
    model.w, model.bias = w, float(b)
    return model


def _margins(model: Model, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values * model.w[cols], minlength=n) + model.bias


def _platt(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Coefficients of a logistic regression of y on the columns of x and a constant, by Newton steps."""
    x = np.column_stack([x, np.ones(len(y))])
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        move = np.linalg.solve(h, x.T @ (y - p) - 1e-3 * beta)
        beta += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return beta


def _subset(view: tuple[np.ndarray, np.ndarray, np.ndarray], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = np.full(len(keep), -1)
    place[keep] = np.arange(int(keep.sum()))
    rows, cols, values = view
    hit = keep[rows]
    return place[rows[hit]], cols[hit], values[hit]


def _views(cols: list[bytes], vals: list[bytes], form: np.ndarray, slots: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> list[tuple]:
    """Sparse rows (row, column, value) of the content and the metadata view."""
    n = len(form)
    sizes = [len(c) // 2 for c in cols]
    words = (np.repeat(np.arange(n), sizes), np.frombuffer(b"".join(cols), "<u2").astype(np.int64), np.frombuffer(b"".join(vals), "<f4").astype(np.float64))
    # the form, standardised and bent at its middle
    z = np.clip((form - centre) / spread, -4, 4)
    dense = np.concatenate([z, np.abs(z)], axis=1) / np.sqrt(2 * _LAYOUT)
    place = (np.repeat(np.arange(n), 2 * _LAYOUT), np.tile(CONTENT + np.arange(2 * _LAYOUT), n), dense.ravel())
    k = slots.shape[1]
    both = (slots[:, 0] * 31 + slots[:, 1] * 17) % NAMES if k > 1 else np.zeros(n, np.int64)
    names = np.column_stack([slots, both]) + NAMES * np.arange(k + 1)
    meta = (np.repeat(np.arange(n), k + 1), names.ravel(), np.full(n * (k + 1), 0.5))
    return [tuple(np.concatenate(x) for x in zip(words, place, strict=True)), meta]


def _sizes(names: int) -> tuple[int, int]:
    return CONTENT + 2 * _LAYOUT, NAMES * (names + 1)


def features(docs: DataFrame, id_col: str, text_col: str, names: list[str]) -> DataFrame:
    """(id, h: hash of the text, cols, vals, form, slots) of each document."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col], docs[text_col].isNull()).alias("h"), *[docs[c].alias(f"m{k}") for k, c in enumerate(names)], docs[text_col].alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list = []
            vals: list = []
            forms: list = []
            for _, _, text in slices(batch.column(2 + len(names))):
                doc, feature, value = content(text)
                cuts = np.searchsorted(doc, np.arange(text.n + 1))
                feature, value = feature.astype("<u2"), value.astype("<f4")
                cols += [feature[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                vals += [value[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                forms += [row.astype("<f8").tobytes() for row in layout(text)]
            slots = np.column_stack([np.zeros((len(batch), 0), np.int64), *[_name_slots(batch.column(2 + k), k) for k in range(len(names))]]).astype("<i8")
            arrays = [batch.column(0), batch.column(1), *[pa.array(x, pa.binary()) for x in (cols, vals, forms, [row.tobytes() for row in slots])]]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "h", "cols", "vals", "form", "slots"])

    return rows.mapInArrow(run, f"id {kind}, h long, cols binary, vals binary, form binary, slots binary")


def _dense(column, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(n, -1)


def _spread(feats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the form over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _dense(batch.column(0).to_pylist(), "<f8", len(batch))
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), *[pa.array([v]) for v in np.concatenate([x.sum(axis=0), (x * x).sum(axis=0)])]], names=["n", *[f"s{k}" for k in range(2 * _LAYOUT)]])

    sums = feats.select("form").mapInArrow(run, "n long" + "".join(f", s{k} double" for k in range(2 * _LAYOUT)))
    row = sums.agg(F.sum("n"), *[F.sum(f"s{k}") for k in range(2 * _LAYOUT)]).first()
    n, x = max(1, row[0] or 0), np.array([v or 0.0 for v in row[1:]])
    centre = x[:_LAYOUT] / n
    return centre, np.sqrt(np.maximum(0, x[_LAYOUT:] / n - centre * centre)) + 1e-6


def odds(model: dict, views: list[tuple], n: int) -> list[np.ndarray]:
    """Calibrated log odds of each view."""
    return [_margins(m, *view, n) * c[0] + c[1] for m, view, c in zip(model["models"], views, model["calibrated"], strict=True)]


def _probability(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _combined(model: dict, views: list[tuple], n: int) -> np.ndarray:
    first, second = odds(model, views, n)
    return _probability(first * model["mix"][0] + second * model["mix"][1] + model["mix"][2])


def _batch_views(model: dict, batch: pa.RecordBatch) -> list[tuple]:
    cols, vals, form, slots = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("cols", "vals", "form", "slots"))
    n = len(batch)
    return _views(cols, vals, _dense(form, "<f8", n), _dense(slots, "<i8", n), model["centre"], model["spread"])


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose features fit in little memory."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _sure(feats: DataFrame, known: DataFrame, model: dict, turn: int) -> list:
    """(view, good, cols, vals, form, slots) of unlabelled documents that a view is sure of, HANDED of either kind and view at most."""
    sent = feats.sparkSession.sparkContext.broadcast(model)
    kind = feats.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            first, second = (_probability(x) for x in odds(sent.value, _batch_views(sent.value, batch), len(batch)))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first), pa.array(second)], names=["id", "h", "p0", "p1"])
            yield out.filter(pa.array((np.minimum(first, second) <= 1 - SURE) | (np.maximum(first, second) >= SURE)))

    scored = feats.mapInArrow(run, f"id {kind}, h long, p0 double, p1 double").join(known.select("id"), "id", "left_anti")
    scored = materialize(scored, "quality-sure")
    order = [F.xxhash64(F.lit(202 + turn), "id", "h"), "id", "h"]
    picked = None
    for v in (0, 1):
        for good in (0, 1):
            some = scored.filter(F.col(f"p{v}") >= SURE if good else F.col(f"p{v}") <= 1 - SURE).select("id", "h").distinct()
            some = some.orderBy(*order).limit(HANDED).select("id", "h", F.lit(v).alias("view"), F.lit(good).alias("good"))
            picked = some if picked is None else picked.unionByName(some)
    return _fetch(feats, picked, ["view", "good"])


def _fetch(feats: DataFrame, picked: DataFrame, columns: list[str]) -> list:
    """Features of the documents picked, few by a bound, each once, in a fixed order."""
    picked = materialize(picked, "quality-picked").withColumnRenamed("id", "id_").withColumnRenamed("h", "h_")
    rows = feats.join(F.broadcast(picked), feats["id"].eqNullSafe(F.col("id_")) & (feats["h"] == F.col("h_")))
    rows = rows.dropDuplicates(["id", "h", *columns]).select("id", "h", *columns, "cols", "vals", "form", "slots").collect()
    return sorted(rows, key=lambda r: (str(r["id"]), r["h"], *[r[c] for c in columns]))


def _arrays(rows: list, centre: np.ndarray, spread: np.ndarray) -> list[tuple]:
    n = len(rows)
    return _views([r["cols"] for r in rows], [r["vals"] for r in rows], _dense([r["form"] for r in rows], "<f8", n), _dense([r["slots"] for r in rows], "<i8", n), centre, spread)


def _learn(rows: list, y: np.ndarray, part: np.ndarray, handed: list[list], model: dict, names: int) -> dict:
    """Models of both views from the labelled rows that do not calibrate and what the other view handed over, calibrated."""
    centre, spread = model["centre"], model["spread"]
    views = _arrays(rows, centre, spread)
    models = []
    for v, size in enumerate(_sizes(names)):
        own, goal = _subset(views[v], ~part), y[~part]
        if handed[v]:
            more = _arrays(handed[v], centre, spread)[v]
            own = (np.concatenate([own[0], more[0] + len(goal)]), np.concatenate([own[1], more[1]]), np.concatenate([own[2], more[2]]))
            goal = np.concatenate([goal, [float(r["good"]) for r in handed[v]]])
        models.append(_fit(*own, goal, len(goal), size, 1e-5))
    margins = np.column_stack([_margins(m, *view, len(rows)) for m, view in zip(models, views, strict=True)])[part]
    calibrated = [_platt(margins[:, v : v + 1], y[part]) for v in (0, 1)]
    both = np.column_stack([margins[:, v] * calibrated[v][0] + calibrated[v][1] for v in (0, 1)])
    return model | {"models": models, "calibrated": calibrated, "mix": _platt(both, y[part])}


def fit(feats: DataFrame, labels: DataFrame, names: list[str], rounds: int = ROUNDS) -> dict | None:
    """The trained classifier as plain arrays, or None without labels of both kinds."""
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("q")).filter("q IS NOT NULL").select(F.col("doc_id").alias("id"), "q")
    chosen = feats.select("id", "h").join(known, "id").distinct().orderBy(F.xxhash64(F.lit(101), "id", "h"), "id", "h").limit(LABELLED)
    rows = _fetch(feats, chosen.select("id", "h", "q"), ["q"])
    y = np.array([float(r["q"] >= 0.5) for r in rows])
    part = np.zeros(len(y), bool)
    part[np.random.default_rng(3).permutation(len(y))[: int(HOLDOUT * len(y))]] = True
    if any(len({*y[m].tolist()}) < 2 for m in (part, ~part)):
        return None
    centre, spread = _spread(feats)
    model: dict = {"centre": centre, "spread": spread}
    handed: list[list] = [[], []]
    for turn in range(rounds + 1):
        model = _learn(rows, y, part, handed, model, len(names))
        if turn < rounds:
            for r in _sure(feats, known, model, turn):
                handed[1 - r["view"]].append(r)
    return model


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", only_kept: bool = False, ids_only: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with ``quality_score__ double`` and ``kept__ boolean``.

    only_kept: the rows kept, without these.  ids_only: (id, quality_score__, kept__), from the features as stored.
    """
    names = [c for c in METADATA if c in docs.columns and c not in (id_col, text_col)]
    feats = materialize(features(docs, id_col, text_col, names), "quality-features")
    model = fit(feats, labels, names)
    kept_columns = [id_col] if ids_only else docs.columns
    scored, verdict = (unused(c, kept_columns) for c in ("quality_score__", "kept__"))
    if model is None:
        return docs if only_kept else docs.select(*kept_columns).withColumn(scored, F.lit(None).cast("double")).withColumn(verdict, F.lit(True))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [StructField(scored, DoubleType()), StructField(verdict, BooleanType())]
    schema = docs.schema if only_kept else StructType(([docs.schema[id_col]] if ids_only else docs.schema.fields) + fields)
    at, named = docs.columns.index(text_col), [docs.columns.index(c) for c in names]

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            p = _combined(sent.value, _batch_views(sent.value, batch), len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= CUTOFF)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.column_stack([np.zeros((len(batch), 0), np.int64), *[_name_slots(batch.column(k), j) for j, k in enumerate(named)]])
            parts = [np.zeros(0)]
            for a, b, text in slices(batch.column(at)):
                doc, feature, value = content(text)
                none = _views([b""] * text.n, [b""] * text.n, layout(text), slots[a:b], sent.value["centre"], sent.value["spread"])
                value = value.astype("<f4").astype(np.float64)  # as stored
                whole = tuple(np.concatenate(x) for x in zip((doc, feature, value), none[0], strict=True))
                parts.append(_combined(sent.value, [whole, none[1]], text.n))
            p = np.concatenate(parts)
            if only_kept:
                yield batch.filter(pa.array(p >= CUTOFF))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(p >= CUTOFF)], names=schema.names)

    return feats.mapInArrow(stored, schema) if ids_only else docs.mapInArrow(run, schema)
