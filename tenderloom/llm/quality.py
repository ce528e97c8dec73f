"""Quality rules: plain counts and n-gram perplexity bands per language.

The language model is a modified Kneser-Ney model over characters, counted with Spark over every
document that reads as text by the plain checks (20 words or more, at most one symbol in ten
words); counting the others too would make junk likely. Lower orders count distinct extensions and every probability is interpolated, so a
stored n-gram needs one look-up; n-grams that weren't counted back off. The model is stored as
sorted arrays of hashes with their log probabilities. (language, n-gram) is hashed to SLOTS
values, which bounds the model to SLOTS entries an order whatever the corpus; of n-grams in
one slot the likelier counts.

A document's perplexity is held against a lower and an upper band of its language. Bands come
from the labelled good documents of the language, widened by MARGIN spreads, or where fewer
than LEAST are labelled good from the quartiles of all its documents, FENCES spreads away.

Null and empty texts have no words, no perplexity and fail the base rules. A null language is a
language of its own. Rows are independent, so repeated rows get equal results. Duplicate lines
and repeated windows are found in whole texts. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tenderloom.llm.common import WORD, text_or_empty
from tenderloom.session import cut_lineage

ORDER = 5
SLOT_BITS = 24
SLOTS = 1 << SLOT_BITS
#: Languages with a model of their own at most, by documents; all others share one.
LANGUAGES = 200
#: Share of good documents inside the bands before they are widened, by how many spreads, and
#: the good documents that a language needs for bands of its own.
INSIDE, MARGIN, LEAST, FENCES = 0.99, 1.0, 50, 4.0
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: What a document must hold to, to be counted for the model.
LEAST_WORDS, SYMBOL_SHARE = 20, 0.1
BLANK = " \t\n\r\x0b\x0c"
#: Log probability where a language has no model.
NOTHING_KNOWN = -10.0
#: Characters handled at once.
CHUNK = 1 << 22
WORDS = re.compile(WORD)
MIX = np.uint64(0x9E3779B97F4A7C15)


# --- characters and n-grams -----------------------------------------------------------------


def normal(text: str) -> str:
    """Lower case with single spaces, after ORDER - 1 spaces that give the first character a context."""
    return " " * (ORDER - 1) + " ".join(text.lower().split())


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and where each ends."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, np.cumsum([len(t) for t in texts])


def starts_of(ends: np.ndarray, total: int) -> np.ndarray:
    """Where n-grams begin that lie in one text."""
    inside = np.ones(total, bool)
    for back in range(1, ORDER):
        at = ends - back
        inside[at[at >= 0]] = False
    return np.flatnonzero(inside)


def count_grams(codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams as rows of code points, and how often each begins at one of the starts."""
    if not len(starts):
        return
    first, last = starts[0], starts[-1] + ORDER
    part = codes[first:last]
    present = np.zeros(0x110000, bool)
    present[part] = True
    letters = np.flatnonzero(present)
    if len(letters) > 4096:  # five numbers of twelve bits fit into a word
        half = len(starts) // 2
        yield from count_grams(codes, starts[:half])
        yield from count_grams(codes, starts[half:])
        return
    number = np.zeros(0x110000, np.uint64)
    number[letters] = np.arange(len(letters), dtype=np.uint64)
    small = number[part]
    at = starts - first
    packed = small[at]
    for k in range(1, ORDER):
        packed = packed << np.uint64(12) | small[at + k]
    packed.sort()
    new = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    seen = packed[new]
    rows = np.stack([letters[(seen >> np.uint64(12 * (ORDER - 1 - k))).astype(np.int64) & 4095] for k in range(ORDER)], axis=1)
    yield rows.astype("<u4"), np.diff(np.append(new, len(packed)))


def slots(columns: list[np.ndarray], language: int) -> np.ndarray:
    """Slot of each n-gram given as one array of code points per place."""
    h = np.full(len(columns[0]), (language * 2 + 1) * int(MIX) & (1 << 64) - 1, np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * MIX
            h ^= h >> np.uint64(29)
        return ((h * MIX) >> np.uint64(64 - SLOT_BITS)).astype(np.uint32)


def strings(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"<U{rows.shape[1]}").ravel()


# --- the model ------------------------------------------------------------------------------


def count(docs: DataFrame) -> DataFrame:
    """(language, gram, n) of all documents; docs has language (a small number) and text."""
    schema = pa.schema([("language", pa.int32()), ("gram", pa.string()), ("n", pa.int64())])

    def counted(language, texts):
        codes, ends = codes_of(texts)
        for rows, n in count_grams(codes, starts_of(ends, len(codes))):
            # Zero characters would be lost from the end of numpy's strings.
            rows[rows == 0] = 0xFFFD
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), language, np.int32)), pa.array(strings(rows).tolist(), pa.string()), pa.array(n.astype(np.int64))], schema=schema)

    def work(batches):
        held: dict[int, list[str]] = {}
        size: dict[int, int] = {}
        for batch in batches:
            for language, text in zip(batch["language"].to_pylist(), batch["text"].to_pylist()):
                t = normal(text)
                words = t.count(" ") - ORDER + 2
                if words < LEAST_WORDS or sum(map(t.count, SYMBOLS)) > words * SYMBOL_SHARE:
                    continue
                held.setdefault(language, []).append(t)
                size[language] = size.get(language, 0) + len(t)
                if size[language] >= CHUNK:
                    yield from counted(language, held.pop(language))
                    size[language] = 0
        for language, texts in held.items():
            yield from counted(language, texts)

    return docs.select("language", "text").mapInArrow(work, "language int, gram string, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))


def _discounts(of: dict[int, int]) -> list[float]:
    """Discounts for counts 1, 2 and 3 or more, from the numbers of n-grams counted 1 to 4 times."""
    n = [0, *(of.get(k, 0) for k in (1, 2, 3, 4))]
    if not all(n[1:]):
        return [0.5, 0.75, 0.9]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3)]


def kneser_ney(grams: DataFrame) -> list[DataFrame]:
    """Per order (1 first): language, gram, p, and the context's back-off as rows of order k - 1."""
    tables = [grams]
    for _ in range(ORDER - 1):
        longer = tables[0]
        tables.insert(0, cut_lineage(longer.groupBy("language", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))))
    lower, out = None, []
    for k, t in enumerate(tables, 1):
        few = t.filter("n <= 4").groupBy("language", "n").count().collect()
        languages = [r.language for r in t.select("language").distinct().collect()]
        rows = [(lang, *_discounts({r.n: r["count"] for r in few if r.language == lang})) for lang in languages]
        discounts = t.sparkSession.createDataFrame(rows, "language int, d1 double, d2 double, d3 double")
        # One row per language, LANGUAGES + 1 at most.
        cut = t.join(F.broadcast(discounts), "language").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        cut = cut.select("language", "gram", F.expr(f"substring(gram, 1, {k - 1})").alias("context"), F.expr("substring(gram, 2)").alias("rest"), "n", "d")
        context = cut.groupBy("language", "context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("backoff"), F.count("*").alias("kinds"))
        if lower is None:
            cut = cut.join(F.broadcast(context), ["language", "context"])  # one row per language
            p = (F.col("n") - F.col("d")) / F.col("total") + F.col("backoff") / (F.col("kinds") + 1)
            made = cut.select("language", "gram", p.alias("p"), "backoff", F.col("kinds"))
        else:
            cut = cut.join(context, ["language", "context"]).join(lower.select("language", F.col("gram").alias("rest"), F.col("p").alias("lower_p")), ["language", "rest"])
            p = (F.col("n") - F.col("d")) / F.col("total") + F.col("backoff") * F.col("lower_p")
            made = cut.select("language", "gram", p.alias("p"), "backoff", F.col("kinds"))
        lower = cut_lineage(made)
        out.append(lower)
    return out


class Model:
    """Sorted slots and log probabilities per order, and back-offs of contexts."""

    def __init__(self, orders, unseen: dict[int, float]):
        self.orders = orders  # per order: slots, log p, context slots, log back-off
        self.unseen = unseen  # log p of a new character, by language

    def log_p(self, codes: np.ndarray, starts: np.ndarray, language: int) -> np.ndarray:
        """Log probability of the last character of each n-gram given those before it."""
        columns = [codes[starts + k] for k in range(ORDER)]
        columns = [np.where(c == 0, 0xFFFD, c) for c in columns]
        total = np.zeros(len(starts))
        rest = np.arange(len(starts))
        for k in range(ORDER, 0, -1):
            tail = [c[rest] for c in columns[ORDER - k :]]
            keys, values, contexts, backs = self.orders[k - 1]
            at, there = _find(keys, slots(tail, language))
            total[rest[there]] += values[at[there]]
            rest = rest[~there]
            if not len(rest):
                return total
            before = [c[~there] for c in tail[:-1]]
            if before:
                at, there = _find(contexts, slots(before, language))
                total[rest[there]] += backs[at[there]]
        total[rest] += self.unseen.get(language, NOTHING_KNOWN)
        return total


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), int), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def fit(docs: DataFrame) -> Model:
    """The model of docs (language, text); at most SLOTS rows an order reach the driver."""

    def hashed(key: str, value: str):
        def work(batches):
            for batch in batches:
                by = pd.DataFrame({"language": batch["language"].to_numpy(), "gram": batch[key].to_pylist(), "v": batch[value].to_numpy()})
                for (language, n), rows in by.groupby(["language", by["gram"].str.len()]):
                    if n:
                        points = np.frombuffer("".join(rows["gram"]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)
                        slot = slots([points[:, i] for i in range(n)], int(language))
                        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(rows["v"].to_numpy(np.float32))], ["slot", "v"])

        return work

    def arrays(df: DataFrame, key: str, value: str):
        best = df.mapInArrow(hashed(key, value), "slot int, v float").groupBy("slot").agg(F.max("v").alias("v"))
        found = best.toArrow()
        slot, v = found["slot"].to_numpy(), found["v"].to_numpy()
        order = np.argsort(slot)
        return slot[order].astype(np.uint32), v[order].astype(np.float32)

    grams = cut_lineage(count(docs))
    orders, unseen = [], {}
    for k, t in enumerate(kneser_ney(grams), 1):
        values = arrays(t.withColumn("p", F.log("p")), "gram", "p")
        if k == 1:
            new = t.groupBy("language").agg(F.log(F.max("backoff") / (F.max("kinds") + 1)).alias("v"))
            unseen = {r.language: r.v for r in new.collect()}
            empty = (np.zeros(0, np.uint32), np.zeros(0, np.float32))
            orders.append((*values, *empty))
        else:
            context = t.groupBy("language", F.expr(f"substring(gram, 1, {k - 1})").alias("context")).agg(F.log(F.max("backoff")).alias("b"))
            orders.append((*values, *arrays(context, "context", "b")))
    return Model(orders, unseen)


# --- rules ----------------------------------------------------------------------------------


def repeated_words(numbers: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Per text: words covered by windows that are found more than once in it.

    numbers stand for words, owner for the text of each, in order.
    """
    covered = np.zeros(texts, np.int64)
    n = len(numbers) - WINDOW + 1
    if n <= 0:
        return covered
    at = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    if not len(at):
        return covered
    with np.errstate(over="ignore"):
        h = owner[at].astype(np.uint64) * MIX
        for k in range(WINDOW):
            h = (h ^ numbers[at + k].astype(np.uint64)) * MIX
            h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    same = np.flatnonzero(h[1:] == h[:-1])
    # Equal hashes are compared in full.
    ok = owner[at[same]] == owner[at[same + 1]]
    for k in range(WINDOW):
        ok &= numbers[at[same] + k] == numbers[at[same + 1] + k]
    same = same[ok]
    step = np.zeros(len(numbers) + 1, np.int64)
    hit = np.unique(np.concatenate([at[same], at[same + 1]]))
    step[hit] += 1
    np.subtract.at(step, hit + WINDOW, 1)
    return np.bincount(owner, np.cumsum(step[:-1]) > 0, texts).astype(np.int64)


def base_counts(texts: list[str]) -> dict[str, np.ndarray]:
    words = [WORDS.findall(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    numbers = pd.factorize(np.array([w for ws in words for w in ws], object))[0] if sizes.sum() else np.zeros(0, np.int64)
    lines = [[x for x in t.split("\n") if x.strip(BLANK)] for t in texts]
    return {
        "n_words": sizes,
        "word_chars": np.array([len(t) - sum(map(t.count, BLANK)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": repeated_words(numbers, np.repeat(np.arange(len(texts)), sizes), len(texts)),
    }


def measure(docs: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """keys, the base counts, log_p (sum) and scored (characters) of each document with language and text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[k] for k in keys]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = docs.select(*keys).schema
    for n in [*names, "scored"]:
        schema = schema.add(n, "long")
    schema = schema.add("log_p", "double")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch["text"].to_pylist()
        out = base_counts(texts)
        log_p, scored = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        languages = batch["language"].to_numpy()
        for language in np.unique(languages):
            of = np.flatnonzero(languages == language)
            codes, ends = codes_of([normal(texts[i]) for i in of])
            starts = starts_of(ends, len(codes))
            owner = np.searchsorted(ends, starts, "right")
            values = np.concatenate([shared.value.log_p(codes, starts[k : k + CHUNK], int(language)) for k in range(0, len(starts), CHUNK)] or [np.zeros(0)])
            log_p[of] = np.bincount(owner, values, len(of))
            scored[of] = np.bincount(owner, minlength=len(of))
        return pa.RecordBatch.from_arrays(
            [*(batch[f.name] for f in fields), *(pa.array(out[n]) for n in names), pa.array(scored), pa.array(log_p)], [*keys, *names, "scored", "log_p"]
        )

    def work(batches):
        for batch in batches:
            sizes = np.cumsum(np.array([len(t) for t in batch["text"].to_pylist()], np.int64))
            at = 0
            while at < batch.num_rows:  # some documents at a time
                until = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, "right")))
                yield rows(batch.slice(at, until - at))
                at = until

    return docs.select(*keys, *(c for c in ("language", "text") if c not in keys)).mapInArrow(work, schema)


def numbered(docs: DataFrame, language: str) -> DataFrame:
    """docs with `language` as a small number: the most frequent ones 0.., all others the last."""
    name = F.coalesce(F.col(language).cast("string"), F.lit(""))
    top = [r[0] for r in docs.groupBy(name.alias("l")).count().orderBy(F.desc("count"), "l").limit(LANGUAGES).collect()]
    table = F.create_map(*(x for i, t in enumerate(top) for x in (F.lit(t), F.lit(i)))) if top else F.create_map().cast("map<string,int>")
    return docs.withColumn("language", F.coalesce(F.element_at(table, name) if top else F.lit(None), F.lit(len(top))).cast("int"))


def surprise() -> Column:
    """The logarithm of perplexity, null without characters."""
    return F.when(F.col("scored") > 0, -F.col("log_p") / F.col("scored"))


def bands(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """language, low, high: bands of the logarithm of perplexity (a row per language)."""
    good = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    known = measured.filter("scored > 0 AND NOT base_failed").withColumn("value", surprise()).join(good, "doc_id", "left")
    shares = F.array(F.lit((1 - INSIDE) / 2), F.lit(0.5), F.lit((1 + INSIDE) / 2))
    found = known.groupBy("language").agg(
        F.percentile_approx("value", F.array(F.lit(0.25), F.lit(0.75)), 10000).alias("every"),
        F.percentile_approx(F.when(F.col("good"), F.col("value")), shares, 10000).alias("best"),
        F.count_if("good").alias("n_good"),
    )
    few, best, every = F.col("n_good") < LEAST, F.col("best"), F.col("every")
    spread = every[1] - every[0]
    low = F.when(few, every[0] - FENCES * spread).otherwise(best[0] - MARGIN * (best[1] - best[0]))
    high = F.when(few, every[1] + FENCES * spread).otherwise(best[2] + MARGIN * (best[2] - best[1]))
    return found.select("language", low.alias("low"), high.alias("high"))


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, base counts, base_failed, perplexity, kept."""
    plain = numbered(docs.select("doc_id", text_or_empty("text").alias("text"), F.col("lang")), "lang").select("doc_id", "language", "text")
    model = fit(plain)
    measured = measure(plain, model, ["doc_id", "language"])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    measured = cut_lineage(measured.withColumn("base_failed", failed))
    limits = bands(measured, labels)
    # A row per language, LANGUAGES + 1 at most.
    both = measured.join(F.broadcast(limits), "language", "left")
    within = F.coalesce(surprise().between(F.col("low"), F.col("high")), F.lit(False))
    return both.withColumn("perplexity", F.exp(surprise())).withColumn("kept", ~F.col("base_failed") & within).drop("low", "high")
