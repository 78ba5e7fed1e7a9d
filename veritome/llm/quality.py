"""Operator 2: quality by the perplexity of an n-gram model with interpolated modified Kneser-Ney smoothing.

Grams are of GRAM characters as they stand, of any script, so the model grows with the trusted texts. It is a table of
grams of all orders with their probabilities and backoff weights, made by joins and sums in shards of grams and
contexts. A task packs its documents into blocks and counts each block's different grams once; these are joined with that
table and what is found meets the packed block again, so no task holds a language's counts. A document's perplexity is
compared with a quantile of that of the trusted texts in its language, at its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.llm.tables import Scratch, written

#: Characters in a gram; about as many characters are in a block, are sorted at once, and are counted together in training.
GRAM, BLOCK, PIECE, COUNTED = 4, 32_000_000, 500_000, 2_000_000
#: Up to so many languages the table of them is broadcast.
LANGUAGES = 10_000
#: Up to so many bytes, counted first, the keys of the trusted texts are broadcast; more of them are joined by a shuffle.
KEY_BYTES = 32 << 20
#: Odd multiplier of the hash of a gram, which stands for it within a task; joins are by the grams themselves.
FACTOR = 0x9E3779B97F4A7C15
#: Quantile of the trusted texts' perplexity beyond which a text of that language is rejected.
QUANTILE = 0.995
#: Least mean distance of the logarithm of perplexities of one length from their mean.
LEAST_SPREAD = 0.01
OTHER = ""


def _points(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after ``order`` - 1 edges (0), and the places of those that aren't edges."""
    edge = "\0" * (order - 1)
    points = np.frombuffer("".join(edge + x for x in texts).encode("utf-32-le", "replace"), "<u4")
    sizes = np.array([len(x) for x in texts], np.int64) + order - 1
    inner = np.ones(len(points), bool)
    for k in range(order - 1):
        inner[np.cumsum(sizes) - sizes + k] = False
    return points, np.flatnonzero(inner)


def _hashes(windows: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each gram, whose characters are the columns given; grams of other lengths differ too."""
    h = np.full(len(windows[0]) if windows else 1, len(windows), np.uint64)
    for column in windows:
        h *= np.uint64(FACTOR)
        h += column
        h ^= h >> np.uint64(29)
    return h


def _strings(windows: np.ndarray) -> list[str]:
    n = windows.shape[1]
    whole = np.ascontiguousarray(windows, "<u4").tobytes().decode("utf-32-le")
    return [whole[i : i + n] for i in range(0, len(whole), n)]


def _grams(points: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the grams that end at the places ``at``."""
    return _hashes([points[at - k] for k in range(order - 1, -1, -1)])


def _pieces(size: np.ndarray) -> list[np.ndarray]:
    """The places of all texts that aren't empty, in runs of about PIECE characters."""
    held = np.flatnonzero(size)
    return np.split(held, np.flatnonzero(np.diff(np.cumsum(size[held]) // PIECE)) + 1) if len(held) else []


def _names(languages: DataFrame) -> DataFrame:
    return F.broadcast(languages) if languages.count() <= LANGUAGES else languages


def train(trusted: DataFrame, text: str = "text", lang: str = "lang", order: int = GRAM) -> DataFrame:
    """``lang, gram, logp, backoff`` for grams of all orders and for contexts, for each language and for all together ("" as name).

    Natural logs; ``logp`` of the empty gram is that of a character never seen. Null texts count as empty, null
    languages only in all together. A lower order counts the different characters before a gram.
    """
    fixed = trusted.select(F.coalesce(F.col(lang).cast("string"), F.lit(OTHER)).alias("lang"), F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, texts in held.items():
                points, at = _points(texts, order)
                _, first, n = np.unique(_grams(points, at, order), return_index=True, return_counts=True)
                found = _strings(points[at[first][:, None] + np.arange(1 - order, 1)])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if one := x.as_py():
                    held.setdefault(name, []).append(one)
                    size += len(one)
                if size >= COUNTED:
                    yield from flush()
                    size = 0
        yield from flush()

    with Scratch() as scratch:
        counts = scratch.written(fixed.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
        every = counts.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(OTHER).alias("lang"), "gram", "n")
        tables = [counts.where(F.col("lang") != OTHER).unionByName(every)]
        for _ in range(order - 1):
            tables.append(tables[-1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")))
        known = tables[0].withColumn("k", F.lit(order))
        for k, t in zip(range(order - 1, 0, -1), tables[1:], strict=True):
            known = known.unionByName(t.withColumn("k", F.lit(k)))
        known = scratch.written(known.withColumn("context", F.expr("substring(gram, 1, k - 1)")), "orders")
        n1, n2, n3, n4 = (F.col(f"n{i}") for i in (1, 2, 3, 4))
        y = n1 / F.greatest(F.lit(1), n1 + 2 * n2)
        free = known.groupBy("lang", "k").agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)))
        raw = ((1, 1 - 2 * y * n2 / F.greatest(F.lit(1), n1)), (2, 2 - 3 * y * n3 / F.greatest(F.lit(1), n2)), (3, 3 - 4 * y * n4 / F.greatest(F.lit(1), n3)))
        free = _names(free.select("lang", "k", *(F.least(F.greatest(d, F.lit(0.05)), F.lit(i - 0.05)).alias(f"d{i}") for i, d in raw)))
        whole = known.groupBy("lang", "k", "context").agg(F.sum("n").alias("total"), *(F.count_if(c).alias(f"m{i}") for i, c in ((1, F.col("n") == 1), (2, F.col("n") == 2), (3, F.col("n") > 2))))
        weight = (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total")
        contexts = scratch.written(whole.join(free, ["lang", "k"]).select("lang", "k", "context", "total", "d1", "d2", "d3", weight.alias("weight"), (F.col("m1") + F.col("m2") + F.col("m3") + 1).alias("symbols")), "contexts")
        own = (F.col("n") - F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))) / F.col("total")
        shares = scratch.written(known.join(contexts, ["lang", "k", "context"]).select("lang", "k", "gram", own.alias("own"), "weight", "symbols"), "shares")
        lower = shares.where("k = 1").select("lang", "gram", (F.col("own") + F.col("weight") / F.col("symbols")).alias("p"))
        orders = [lower]
        for k in range(2, order + 1):
            below = lower.select("lang", F.col("gram").alias("rest"), F.col("p").alias("below"))
            lower = scratch.written(shares.where(F.col("k") == k).withColumn("rest", F.expr("substring(gram, 2)")).join(below, ["lang", "rest"]).select("lang", "gram", (F.col("own") + F.col("weight") * F.col("below")).alias("p")), "order")
            orders.append(lower)
        none = F.lit(None).cast("double")
        rows = contexts.select("lang", F.col("context").alias("gram"), F.when(F.col("k") == 1, -F.log(F.col("symbols").cast("double"))).alias("logp"), F.log("weight").alias("backoff"))
        for x in orders:
            rows = rows.unionByName(x.select("lang", "gram", F.log("p").alias("logp"), none.alias("backoff")))
        return written(rows.groupBy("lang", "gram").agg(F.max("logp").alias("logp"), F.max("backoff").alias("backoff")), "model")


def perplexity(docs: DataFrame, model: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = GRAM) -> DataFrame:
    """``key, lang, n_chars, perplexity`` for each row; the perplexity of an empty or null text is null. The result is a table in the shared folder."""
    fixed = docs.select(F.col(key).alias("key"), F.coalesce(F.col(lang).cast("string"), F.lit(OTHER)).alias("lang"), F.col(text).cast("string").alias("text"))
    names = model.where("gram = ''").select("lang", F.col("lang").alias("model"))
    named = fixed.join(_names(names), "lang", "left").select("key", "lang", F.coalesce("model", F.lit(OTHER)).alias("model"), "text")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of rows, packed, and the different grams and contexts in each."""
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(rows)
            yield made(number, [None], [None], [sink.getvalue().to_pybytes()])
            for name in pc.unique(rows.column("model")).to_pylist():
                texts = rows.filter(pc.equal(rows.column("model"), name)).column("text")
                tops = [np.zeros((0, order), "<u4")]
                for piece in _pieces(pc.fill_null(pc.utf8_length(texts), 0).to_numpy()):
                    points, at = _points(texts.take(pa.array(piece)).to_pylist(), order)
                    ends = at[np.unique(_grams(points, at, order), return_index=True)[1]]
                    tops.append(points[ends[:, None] + np.arange(1 - order, 1)])
                top = np.concatenate(tops)
                found = [""]
                for k in range(order, 0, -1):  # grams, and below the highest order contexts of the next one too
                    chars = top if k == order else np.concatenate((top[:, order - k :], top[:, order - k - 1 : -1]))
                    chars = chars[np.unique(_hashes(list(chars.T)), return_index=True)[1]]
                    found += _strings(chars)
                    if k == order:
                        top = chars
                yield made(number, [name] * len(found), found, [None] * len(found))

        def made(number: int, *columns: list) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([number] * len(columns[0]), pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["block", "lang", "gram", "packed"])

        for batch in batches:
            lengths = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:  # up to the row that fills the block
                before = int(lengths[at - 1]) if at else 0
                end = min(batch.num_rows, int(np.searchsorted(lengths, before + BLOCK - size)) + 1)
                held.append(batch.slice(at, end - at))
                size += int(lengths[end - 1]) - before
                at = end
                if size >= BLOCK:
                    yield from block()
                    number, held, size = number + 1, [], 0
        if held:
            yield from block()

    def answer(packed: pa.Table, told: pa.Table) -> pa.Table:
        rows = pa.ipc.open_stream(packed.column("packed")[0].as_buffer()).read_all()
        size = pc.fill_null(pc.utf8_length(rows.column("text")), 0).to_numpy().astype(np.int64)
        out = np.full(len(size), np.nan)
        models = np.array(rows.column("model").to_pylist(), object)
        for name in set(models):
            own = told.filter(pc.equal(told.column("lang"), name))
            length = pc.utf8_length(own.column("gram")).to_numpy()
            seen = {}
            for k in range(order + 1):
                part = own.filter(pa.array(length == k))
                chars = np.frombuffer("".join(part.column("gram").to_pylist()).encode("utf-32-le"), "<u4").reshape(len(part), k)
                h = _hashes([chars[:, i] for i in range(k)])[: len(part)]
                by = np.argsort(h)
                seen[k] = h[by], *(pc.fill_null(part.column(c), np.nan).to_numpy()[by] for c in ("logp", "backoff"))

            def look(points: np.ndarray, ends: np.ndarray, k: int, column: int, seen: dict = seen) -> np.ndarray:
                values = seen[k]
                if not len(values[0]):
                    return np.full(len(ends), np.nan)
                if not k:
                    return np.full(len(ends), values[column][0])
                h = _grams(points, ends, k)
                place = np.minimum(np.searchsorted(values[0], h), len(values[0]) - 1)
                return np.where(values[0][place] == h, values[column][place], np.nan)

            for mine in _pieces(np.where(models == name, size, 0)):
                points, at = _points(rows.column("text").take(pa.array(mine)).to_pylist(), order)
                _, first, which = np.unique(_grams(points, at, order), return_index=True, return_inverse=True)
                top = at[first]
                logp = np.nan_to_num(look(points, top, 0, 1), nan=-np.log(0x110000))
                for k in range(1, order + 1):
                    here = look(points, top, k, 1)
                    logp = np.where(np.isnan(here), logp + np.nan_to_num(look(points, top - 1, k - 1, 2)), here)
                out[mine] = np.exp(-np.add.reduceat(logp[which], np.cumsum(size[mine]) - size[mine]) / size[mine])
        return pa.table({"key": rows.column("key"), "lang": rows.column("lang"), "n_chars": pa.array(size), "perplexity": pa.array(out, pa.float64(), from_pandas=True)})

    with Scratch() as scratch:
        buckets = min(100_000, 1 + 2 * (fixed.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK)
        asked = scratch.bucketed(named.mapInArrow(ask, "block long, lang string, gram string, packed binary"), "asked", buckets, "block")
        told = asked.where("packed is null").select(F.col("block").alias("of"), "lang", "gram").join(model, ["lang", "gram"])
        blocks = asked.where("packed is not null").select("block", "packed")
        kind = fixed.schema["key"].dataType.simpleString()
        return written(blocks.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(answer, f"key {kind}, lang string, n_chars long, perplexity double"), "perplexity")


def thresholds(trusted: DataFrame, by: str, quantile: float = QUANTILE) -> DataFrame:
    """``by, m0, m1, s0, s1, z``: lines for the mean of the logarithm of perplexity over one through the length, and for its distance from that over one through the length's root, and the quantile of deviations so measured.

    Short texts vary more; one rule holds at every length and for any number of texts. trusted: ``by``, n_chars, perplexity.
    """
    seen = trusted.select(by, "n_chars", F.log("perplexity").alias("y"), (1 / F.col("n_chars")).alias("x"), (1 / F.sqrt("n_chars")).alias("w"))
    mean = seen.groupBy(by).agg(*_line("y", "x", "m"))
    off = seen.join(_names(mean), by).withColumn("r", F.abs(F.col("y") - _mean(F.col("n_chars"))))
    spread = mean.join(off.groupBy(by).agg(*_line("r", "w", "s")), by)
    z = (F.col("y") - _mean(F.col("n_chars"))) / _spread(F.col("n_chars"))
    return spread.join(seen.join(_names(spread), by).groupBy(by).agg(F.percentile_approx(z, quantile, 10_000).alias("z")), by)


def _line(y: str, x: str, name: str) -> list:
    slope = F.coalesce(F.regr_slope(F.col(y), F.col(x)), F.lit(0.0))
    return [(F.avg(y) - slope * F.avg(x)).alias(f"{name}0"), slope.alias(f"{name}1")]


def _mean(n):
    return F.col("m0") + F.col("m1") / n


def _spread(n):
    return F.greatest(F.col("s0") + F.col("s1") / F.sqrt(n), F.lit(LEAST_SPREAD))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "quality", quantile: float = QUANTILE) -> DataFrame:
    """``key, lang, perplexity, threshold, held_out, keep`` for each row.

    Trusted are texts labelled 1 whose key's checksum doesn't hold them out; a quarter of
    them, by a hash of the key, sets the thresholds and the rest the counts, as a model's own
    texts surprise it too little. Empty and null texts are not kept. A language without trusted texts is held to the threshold
    of all of them; without any trusted text all with text are kept. Repeated rows are
    each judged; null keys are untrusted; other columns are left out, whatever their names.
    """
    held = F.coalesce(F.crc32(F.col("key").cast("string")) % 3 == 1, F.lit(False))
    good = labels.where(F.col(label) == 1).select(F.col(key).alias("key")).where(F.col("key").isNotNull() & ~held).distinct()
    measure = F.pmod(F.xxhash64("key"), F.lit(4)) == 0
    counted = good.where(~measure)
    fixed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    size = counted.agg(F.sum(8 + F.octet_length(F.col("key").cast("string")))).first()[0] or 0
    counted = F.broadcast(counted) if size <= KEY_BYTES else counted.hint("merge")
    model = train(fixed.join(counted, "key", "left_semi"))
    scored = perplexity(fixed, model, "key")
    trusted = scored.join(good.where(measure), "key", "left_semi").where("perplexity is not null")
    limits = thresholds(trusted, "lang", quantile)
    pooled = thresholds(trusted.withColumn("lang", F.lit(OTHER)), "lang", quantile).first()  # one row, or none
    told = scored.join(_names(limits), "lang", "left")
    for name in ("m0", "m1", "s0", "s1", "z"):
        told = told.withColumn(name, F.coalesce(name, F.lit(pooled[name] if pooled else None).cast("double")))
    n = F.col("n_chars")
    threshold = F.when(n > 0, F.exp(_mean(n) + F.col("z") * _spread(n)))
    told = told.withColumn("threshold", threshold)
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return told.select(F.col("key").alias(key), "lang", "perplexity", "threshold", held.alias("held_out"), keep.alias("keep"))
