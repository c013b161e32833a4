"""Language identification with interpolated Kneser-Ney character models, one per language.

Counts of all character runs of ORDER letters are gathered from all training texts by Spark, keyed by 64-bit hashes.
Shorter runs count in how many ways they are continued to the left. Discounts, back-off weights and probabilities are
joins and aggregations per order, so the driver sees none of them. The result is a table of hashes with one
log-probability per language; a run unknown to every language falls back to the next shorter one, with the back-off weight
of its history. The table grows with the distinct runs of the corpus: up to MODEL_BYTES it is broadcast as sorted
arrays, beyond that the runs of the texts are joined with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .shared import drop, kept

ORDER = 4
DISCOUNT = 0.75
#: Up to so many bytes, the models are sent to the tasks; larger ones are joined.
MODEL_BYTES = 256 << 20
#: Share of a language's texts whose score may fall below the rejection level.
REJECTED = 0.01

#: kind 0: log-probabilities of a run's last character; kind 1: back-off weights of a history of that length.
_MODEL = "kind int, order int, key bigint, logs array<float>"


class _Characters:
    """For each code point: its lower-case form if it is a letter, else 0. Built once per worker."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            table = np.zeros(0x110000, np.uint32)
            for c in range(0x323B0):
                ch = chr(c)
                if ch.isalpha():
                    low = ch.lower()
                    table[c] = ord(low) if len(low) == 1 else c
            cls.table = table
        return cls.table


def _letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, each run of other characters as one 0; and the range of each text.

    A text with a letter starts and ends with a 0; one without has an empty range."""
    sizes = np.array([len(t or "") + 2 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    joined = "\0" + "\0\0".join([t or "" for t in texts]) + "\0"
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    flat = _Characters.get()[flat]
    keep = flat > 0
    keep[1:] |= flat[:-1] > 0
    starts = ends - sizes
    some = np.add.reduceat(flat > 0, starts) > 0 if len(starts) else np.zeros(0, bool)
    keep[starts[some]] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    return flat[keep], np.stack([total[starts], total[ends]], axis=1) if len(starts) else np.zeros((0, 2), np.int64)


def _run_keys(letters: np.ndarray, order: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Hash of the run of `order` characters from each place, or from the given places."""
    if starts is None:
        starts = slice(0, max(0, len(letters) - order + 1))
        runs = [letters[k : starts.stop + k] for k in range(order)]
    else:
        runs = [letters[starts + k] for k in range(order)]
    h = np.full(len(runs[0]), order, np.uint64)
    for characters in runs:
        h = (h ^ characters) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return scan.mix(h).view(np.int64)


def _inside(ranges: np.ndarray, order: int, n: int) -> np.ndarray:
    """Whether the run of `order` characters that starts at each place lies within one text."""
    edge = np.zeros(n + 1, np.int64)
    lo, hi = ranges[:, 0], np.maximum(ranges[:, 1] - order + 1, ranges[:, 0])
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    return np.cumsum(edge)[: max(0, n - order + 1)] > 0


def _numbered(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 without gaps, equal for equal codes, and one place of each number. Codes are below `size`."""
    if size > 4 * len(codes) + (1 << 16):
        _, place, number = np.unique(codes, return_index=True, return_inverse=True)
        return number, place
    place = np.full(size, -1, np.int32)
    place[codes] = np.arange(len(codes), dtype=np.int32)
    known = np.flatnonzero(place >= 0)
    number = np.empty(size, np.int64)
    number[known] = np.arange(len(known))
    return number[codes], place[known]


def _run_numbers(letters: np.ndarray, kinds: np.ndarray | None, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, as by _numbered(), of the runs of ORDER characters from the given places; with `kinds`, runs differ by the kind of their place.

    A run is numbered by the number of the run without its last character, so that codes stay small and need no hash."""
    if not len(places):
        return places, places
    letter, of_letter = _numbered(letters.astype(np.int64), int(letters.max()) + 1)
    size, run, found = len(of_letter), letter, len(of_letter)
    if kinds is not None:
        run, found = letter + kinds * size, size * (int(kinds.max()) + 1)
    for k in range(1, ORDER):
        code, found = run[: len(letters) - k] * size + letter[k:], found * size
        if k == ORDER - 1:
            code = code[places]
        run, place = _numbered(code, found)
        found = len(place)
    return run, place


def _slices(column: pa.Array, limit: int = 1 << 19):
    """Runs of rows with about `limit` bytes of text."""
    for lo, hi, _, _ in scan.pieces(column, limit):
        yield lo, hi, column.slice(lo, hi - lo).to_pylist()


def _counted(batches):
    """Rows (lang, order, key, history, shorter, n): distinct runs within each slice of a batch.

    Only the longest runs are counted at all places. A shorter one is the end of a longer one, or starts a text."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lo, hi, texts in _slices(batch.column("text"), 1 << 20):
            letters, ranges = _letters(texts)
            names = sorted(set(langs[lo:hi]))
            code = np.array([names.index(x) for x in langs[lo:hi]])
            whose = np.repeat(code, ranges[:, 1] - ranges[:, 0])
            salt = scan.mix(np.arange(1, len(names) + 1, dtype=np.uint64)).view(np.int64)
            places = np.flatnonzero(_inside(ranges, ORDER, len(letters)))
            for order in range(ORDER, 0, -1):
                if order == ORDER:
                    number, first = _run_numbers(letters, whose, places)
                    n = np.bincount(number, minlength=len(first))
                    places = places[first]
                    keys = _run_keys(letters, order, places)
                else:
                    begins = ranges[ranges[:, 1] - ranges[:, 0] >= order, 0]
                    places = np.concatenate((places + 1, begins))
                    keys = _run_keys(letters, order, places)
                    _, first, n = np.unique(keys ^ salt[whose[places]], return_index=True, return_counts=True)
                    places, keys = places[first], keys[first]
                if not len(places):
                    continue
                none = np.zeros(len(places), np.int64)
                history, shorter = (_run_keys(letters, order - 1, places + k) if order > 1 else none for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.string()).take(pa.array(whose[places])),
                        pa.array(np.full(len(places), order, np.int32)),
                        *(pa.array(x) for x in (keys, history, shorter)),
                        pa.array(n.astype(np.int64)),
                    ],
                    ["lang", "order", "key", "history", "shorter", "n"],
                )


def _added(counts: DataFrame) -> DataFrame:
    """One row per language and run."""
    same = [F.min(c).alias(c) for c in ("history", "shorter")]
    return counts.groupBy("lang", "order", "key").agg(*same, F.sum("n").alias("n"))


def _by_lang(count: int, *values: tuple[str, float]) -> list[Column]:
    """Aggregates that gather each value into an array with one element per language, or a default."""

    def gathered(name: str, default: float) -> Column:
        found = F.map_from_entries(F.collect_list(F.struct("lang", name)))
        each = F.sequence(F.lit(0), F.lit(count - 1))
        return F.transform(each, lambda i: F.coalesce(F.try_element_at(found, i), F.lit(float(default)))).alias(name)

    return [gathered(*value) for value in values]


def _logs(values: Column) -> Column:
    return F.transform(values, lambda p: F.log(F.greatest(p, F.lit(1e-12))).cast("float")).alias("logs")


class Models:
    """Names of the languages, a table [kind, order, key, logs], and one floor and rejection level per language."""

    def __init__(self, counts: DataFrame, langs: list[str]):
        """From counts [lang, order, key, history, shorter, n], one row per language and run; lang counts from 0."""
        self.langs, size = langs, len(langs)
        self.level = np.full(size, -np.inf)
        self.floor = np.zeros(size)
        self._local: Arrays | None = None
        self.table, self.rows = None, 0
        if not langs:
            return
        levels, lower = [], None
        for order in range(1, ORDER + 1):
            runs = counts.where(F.col("order") == order)
            if order < ORDER:
                ways = counts.where(F.col("order") == order + 1).groupBy("lang", F.col("shorter").alias("key")).agg(F.count("*").alias("ways"))
                runs = runs.join(ways, ["lang", "key"], "left").withColumn("n", F.coalesce("ways", F.lit(0)))
            runs = runs.select("lang", "key", "history", "shorter", F.col("n").cast("double").alias("n"))
            by_key = runs.groupBy("key").agg(*_by_lang(size, ("n", 0)), F.min("history").alias("history"), F.min("shorter").alias("shorter"))
            if order == 1:
                runs = kept(runs, "characters")
                total = np.zeros(size)
                for lang, n in runs.groupBy("lang").agg(F.sum("n")).collect():
                    total[lang] = n
                kinds = runs.select("key").distinct().count() + 1
                drop(runs)
                share = total + 0.5 * kinds
                self.floor = np.log(0.5 / share)
                shares = F.array(*[F.lit(float(x)) for x in share])
                p = F.zip_with("n", shares, lambda n, s: (n + 0.5) / s)
                lower = kept(by_key.select("key", p.alias("p")), "probabilities")
            else:
                sums = runs.groupBy("history", "lang").agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).cast("double").alias("types"))
                sums = sums.where("total > 0").withColumn("weight", DISCOUNT * F.col("types") / F.col("total"))
                sums = kept(sums.groupBy("history").agg(*_by_lang(size, ("weight", 1), ("total", 0))), "histories")
                levels.append(sums.select(F.lit(1).alias("kind"), F.lit(order - 1).alias("order"), F.col("history").alias("key"), _logs(F.col("weight"))))
                joined = by_key.join(sums, "history", "left").join(lower.withColumnRenamed("key", "shorter"), "shorter")
                down = F.coalesce(F.zip_with("weight", "p", lambda w, q: w * q), F.col("p"))
                own = F.coalesce(F.zip_with("n", "total", lambda n, t: F.greatest(n - DISCOUNT, F.lit(0.0)) / F.greatest(t, F.lit(1e-9))), F.transform("n", lambda n: n * 0))
                p = F.zip_with(own, down, lambda a, b: F.least(a + b, F.lit(1.0)))
                lower = kept(joined.select("key", p.alias("p")), "probabilities")
            levels.append(lower.select(F.lit(0).alias("kind"), F.lit(order).alias("order"), "key", _logs(F.col("p"))))
        table = levels[0]
        for level in levels[1:]:
            table = table.unionByName(level)
        self.table = kept(table, "models")
        self.rows = self.table.count()

    def bytes(self) -> int:
        return self.rows * (24 + 4 * len(self.langs))  # a hash, up to four buckets, the logarithms

    def local(self) -> Arrays | None:
        """The sorted arrays, or None if they are larger than MODEL_BYTES."""
        if self._local is None and self.bytes() <= MODEL_BYTES:
            self._local = Arrays(self.table.toArrow() if self.rows else None, len(self.langs), self.floor)
        return self._local

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return self.local().scores(texts)


class Arrays:
    """Sorted hashes of each order, and for each hash the logarithms of all languages."""

    def __init__(self, table: pa.Table | None, count: int, floor: np.ndarray):
        self.count, self.floor = count, floor.astype(np.float32)
        self.parts = {}
        if table is None:
            return
        kind, order, key = (table.column(c).to_numpy() for c in ("kind", "order", "key"))
        logs = table.column("logs").combine_chunks().flatten().to_numpy().reshape(-1, count)
        for k in (0, 1):
            for o in range(1, ORDER + 1 - k):
                own = np.flatnonzero((kind == k) & (order == o))
                if len(own):
                    own = own[np.argsort(key[own])]
                    self.parts[k, o] = key[own], *self._bucketed(key[own]), logs[own]

    @staticmethod
    def _bucketed(known: np.ndarray) -> tuple[int, np.ndarray]:
        """Hashes fall evenly into two to four buckets each by their upper bits: the shift, and the first place of each bucket."""
        bits = len(known).bit_length() + 1
        first = np.zeros(1 << bits, np.int32)
        first[1:] = np.cumsum(np.bincount((known >> (64 - bits)) + (1 << (bits - 1)), minlength=1 << bits))[:-1]
        return 64 - bits, np.minimum(first, len(known) - 1)

    def _found(self, kind: int, order: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key among the sorted hashes, -1 for unknown ones, and the logarithms that belong to the places."""
        if (kind, order) not in self.parts:
            return np.full(len(keys), -1), None
        known, shift, first, logs = self.parts[kind, order]
        at = first[(keys >> shift) + len(first) // 2]
        behind = np.flatnonzero((known[at] < keys) & (at < len(known) - 1))
        while len(behind):
            at[behind] += 1
            behind = behind[(known[at[behind]] < keys[behind]) & (at[behind] < len(known) - 1)]
        return np.where(known[at] == keys, at, -1), logs

    def scores(self, texts: list[str | None], langs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-probability per character of each text in each language; characters scored of each text.

        With `langs`, one language for each text, only that one is scored. A character's logarithms depend on the run of
        ORDER characters that it ends, so each distinct run of a slice is looked up once."""
        letters, ranges = _letters(texts)
        sizes = ranges[:, 1] - ranges[:, 0]
        owner = np.repeat(np.arange(len(texts)), sizes)
        depth = np.arange(len(letters)) - np.repeat(ranges[:, 0], sizes)
        deep, shallow = np.flatnonzero(depth >= ORDER - 1), np.flatnonzero(depth < ORDER - 1)
        number, first = _run_numbers(letters, None, deep - (ORDER - 1))
        at = np.concatenate((deep[first], shallow))
        value = self._values(letters, at, depth[at])
        value[depth[at] == 0] = 0.0  # the opening gap is given, not predicted
        which = np.empty(len(letters), np.int64)
        which[deep], which[shallow] = number, len(first) + np.arange(len(shallow))
        if langs is None:
            each = (column[which] for column in value.T.astype(float))
        else:
            each = [value.ravel()[which * self.count + np.repeat(langs, sizes)]]
        sums = np.stack([np.bincount(owner, column, minlength=len(texts)) for column in each], axis=1)
        chars = np.maximum(sizes - 1, 0)
        return sums / np.maximum(chars, 1)[:, None], chars

    def _values(self, letters: np.ndarray, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Logarithms in each language of the characters at some places of given depths in their texts."""
        value = np.empty((len(at), self.count), np.float32)
        rest, carried = np.arange(len(at)), np.zeros((len(at), self.count), np.float32)  # characters without a known run yet, and back-off so far
        for order in range(ORDER, 0, -1):
            fits = depth[rest] >= order - 1
            slot = np.full(len(rest), -1)
            slot[fits], logs = self._found(0, order, _run_keys(letters, order, at[rest[fits]] - (order - 1)))
            hit = slot >= 0
            if hit.any():
                value[rest[hit]] = logs[slot[hit]] + carried[hit]
            fits, rest, carried = fits[~hit], rest[~hit], carried[~hit]
            if order > 1:
                missed = np.flatnonzero(fits)
                history, weights = self._found(1, order - 1, _run_keys(letters, order - 1, at[rest[missed]] - (order - 1)))
                known = history >= 0
                if known.any():
                    carried[missed[known]] += weights[history[known]]
        value[rest] = self.floor[None] + carried
        return value


def _chains(batches):
    """Rows (name, n, order, r1 .. r4, h1 .. h3, times): the distinct predicted characters of each text with all runs that end in them.

    rK is the run of K characters, hK the history of K characters; order is the longest run that fits in the text."""
    for batch in batches:
        for lo, hi, texts in _slices(batch.column("text")):
            letters, ranges = _letters(texts)
            owner = np.repeat(np.arange(len(texts)), ranges[:, 1] - ranges[:, 0])
            depth = np.arange(len(letters)) - ranges[owner, 0]
            for order in range(2, ORDER + 1):
                at = np.flatnonzero(depth == order - 1 if order < ORDER else depth >= order - 1)
                keys = _run_keys(letters, order, at - order + 1)
                salt = scan.mix(owner[at].astype(np.uint64) + np.uint64(1)).view(np.int64)
                _, first, times = np.unique(keys ^ salt, return_index=True, return_counts=True)
                at, whose = at[first], pa.array(owner[at[first]] + lo)
                absent = pa.nulls(len(at), pa.int64())
                runs = [pa.array(_run_keys(letters, k, at - k + 1)) if k <= order else absent for k in range(1, ORDER + 1)]
                histories = [pa.array(_run_keys(letters, k, at - k)) if k < order else absent for k in range(1, ORDER)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("name").take(whose), batch.column("n").take(whose), *runs, *histories, pa.array(times.astype(np.int64))],
                    ["name", "n", *(f"r{k}" for k in range(1, ORDER + 1)), *(f"h{k}" for k in range(1, ORDER)), "times"],
                )


def _joined(texts: DataFrame, models: Models) -> DataFrame:
    """[name, n, lang, mean, chars] of distinct texts [text, name, n], by joins of their runs with the table of the models."""
    numbers = [f"{c}{k}" for k in range(1, ORDER + 1) for c in ("r", "h") if c == "r" or k < ORDER]
    kind = ", ".join(f"{c} bigint" for c in ["name", "n", *(f"r{k}" for k in range(1, ORDER + 1)), *(f"h{k}" for k in range(1, ORDER)), "times"])
    out = texts.mapInArrow(_chains, kind)
    for c in numbers:
        part = models.table.where((F.col("kind") == int(c[0] == "h")) & (F.col("order") == int(c[1:])))
        out = out.join(part.select(F.col("key").alias(c), F.col("logs").alias(f"l{c}")), c, "left")
    zero = F.array_repeat(F.lit(0.0).cast("float"), len(models.langs))
    value = F.coalesce("lr1", F.array(*[F.lit(float(x)).cast("float") for x in models.floor]))
    for k in range(2, ORDER + 1):
        value = F.coalesce(f"lr{k}", F.zip_with(F.coalesce(f"lh{k - 1}", zero), value, lambda a, b: a + b))
    each = out.select("name", "n", "times", F.posexplode(value).alias("lang", "log"))
    sums = each.groupBy("name", "n", "lang").agg(F.sum(F.col("times") * F.col("log").cast("double")).alias("log"), F.sum("times").alias("chars"))
    return sums.select("name", "n", "lang", (F.col("log") / F.col("chars")).alias("mean"), "chars")


def _name(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("name"), F.octet_length(text).cast("bigint").alias("n")]


def _own_scores(shared):
    """(lang, score): what each training text gets from the model of its own language."""

    def run(batches):
        for batch in batches:
            langs = batch.column("lang").to_numpy()
            for lo, hi, texts in _slices(batch.column("text")):
                mean, chars = shared.value.scores(texts, langs[lo:hi])
                some = np.flatnonzero(chars > 0)
                yield pa.RecordBatch.from_arrays([pa.array(langs[lo:hi][some], pa.int32()), pa.array(mean[some, 0])], ["lang", "score"])

    return run


def _scored(texts: DataFrame, models: Models) -> DataFrame:
    """[lang, score]: what texts [text, lang] get from the model of their own language, written down."""
    if (arrays := models.local()) is not None:
        shared = texts.sparkSession.sparkContext.broadcast(arrays)
        scores = kept(texts.mapInArrow(_own_scores(shared), "lang int, score double"), "scores")
        shared.unpersist()
        return scores
    named = texts.select("text", "lang", *_name(F.col("text")))
    means = _joined(named.dropDuplicates(["name", "n"]).select("text", "name", "n"), models)
    return kept(named.join(means, ["name", "n", "lang"]).select("lang", F.col("mean").alias("score")), "scores")


def _levels(scores: DataFrame, count: int) -> np.ndarray:
    """The rejection level of each language from the scores of texts that the scoring model has not seen.

    A language without scores takes the lowest level of the others."""
    found = dict(scores.groupBy("lang").agg(F.percentile_approx("score", REJECTED)).collect())
    lowest = min(found.values(), default=-np.inf)
    return np.array([found.get(k, lowest) for k in range(count)])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Models:
    """Models of every non-null language of docs, from the counts of all their texts.

    For the rejection levels the texts are halved by hash, so copies stay together, and the models of each half score all
    texts of the other: a quantile of all scores of a language is its level. A language that has texts in one half only
    has no such scores. The driver holds the names of the languages, and the finished models if they are not larger than
    MODEL_BYTES.
    """
    source = docs.select(docs[text_col].alias("text"), docs[lang_col].alias("lang")).where("text is not null and lang is not null")
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")
    found = [(r["lang"], r["half"]) for r in source.select("lang", half.alias("half")).distinct().collect()]  # two rows a language
    langs = sorted({lang for lang, _ in found})
    schema = "lang string, order int, key bigint, history bigint, shorter bigint, n bigint"
    names = source.sparkSession.createDataFrame([(k, lang, {(lang, 0), (lang, 1)} <= set(found)) for k, lang in enumerate(langs)], "code int, lang string, both boolean")

    def counted(texts: DataFrame, name: str) -> DataFrame:
        runs = _added(texts.mapInArrow(_counted, schema)).join(F.broadcast(names), "lang")
        return kept(runs.select(F.col("code").alias("lang"), "order", "key", "history", "shorter", "n"), name)

    counts = [counted(source.where(half == k), "counts") for k in (0, 1)]
    scores = []
    for k in (0, 1) if langs else ():
        models = Models(counts[k], langs)
        others = source.where(half != k).join(F.broadcast(names.where("both")), "lang").select("text", F.col("code").alias("lang"))
        scores.append(_scored(others, models))
        drop(models.table)
        del models
    models = Models(kept(_added(counts[0].unionByName(counts[1])), "counts-all"), langs)
    if langs:
        models.level = _levels(scores[0].unionByName(scores[1]), len(langs))
    for table in (*counts, *scores):
        drop(table)
    return models


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text", *extra: Column) -> DataFrame:
    """[id_col, ...extra, lang_pred, score, cross_entropy, rejected], one row per row of docs.

    lang_pred is the language with the smallest cross-entropy per character (ties: the first by name), score its
    posterior under equal priors for a text of up to 50 characters, from 0 to 1. rejected is true if the cross-entropy
    is worse than that of all but REJECTED of the training texts of that language, scored by models that had not seen them.

    * A null text, or one without letters, is 'und' with score 0 and is rejected; so is every text if there are no models.
    * A very long text is scored whole in one task, with about 80 bytes of arrays per character.
    * Repeated rows and null or repeated ids are passed through. An empty table gives an empty table.
    """
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *extra)
    more = [c for c in source.columns if c not in ("id", "text")]
    if models.langs and models.local() is None:
        return _identified_by_joins(source, models, more).withColumnRenamed("id", id_col)
    langs, level = models.langs, models.level
    shared = docs.sparkSession.sparkContext.broadcast(models.local() if langs else None)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select("id", *more).schema)

    def run(batches):
        for batch in batches:
            rest = batch.select(["id", *more])
            for lo, hi, texts in _slices(batch.column("text")):
                names, score, entropy, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
                if langs:
                    mean, chars = shared.value.scores(texts)
                    best = mean.argmax(axis=1)
                    top = mean[np.arange(len(texts)), best]
                    odds = np.exp((mean - top[:, None]) * np.minimum(chars, 50)[:, None]).sum(axis=1)
                    some = chars > 0
                    names = [langs[b] if s else "und" for b, s in zip(best, some)]
                    score = np.where(some, 1 / odds, 0.0)
                    entropy = np.where(some, -top, np.nan)
                    rejected = ~some | (top < level[best])
                part = rest.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(score), pa.array(entropy, mask=np.isnan(entropy)), pa.array(rejected)],
                    [*part.schema.names, "lang_pred", "score", "cross_entropy", "rejected"],
                )

    out = source.mapInArrow(run, f"{fields}, lang_pred string, score double, cross_entropy double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def _identified_by_joins(source: DataFrame, models: Models, more: list[str]) -> DataFrame:
    """identify() for models that are too large to send to the tasks."""
    spark = source.sparkSession
    labels = [(k, lang, float(level)) for k, (lang, level) in enumerate(zip(models.langs, models.level))]
    named = source.withColumns(dict(zip(("_name", "_n"), _name(F.col("text")))))
    texts = named.where("text is not null").dropDuplicates(["_name", "_n"]).select("text", F.col("_name").alias("name"), F.col("_n").alias("n"))
    of_text = Window.partitionBy("name", "n")
    means = _joined(texts, models).withColumn("top", F.max("mean").over(of_text))
    odds = F.sum(F.exp((F.col("mean") - F.col("top")) * F.least("chars", F.lit(50))))
    best = means.groupBy("name", "n").agg(F.min(F.when(F.col("mean") == F.col("top"), F.col("lang"))).alias("lang"), F.max("top").alias("top"), odds.alias("odds"))
    labelled = best.join(F.broadcast(spark.createDataFrame(labels, "lang int, lang_pred string, level double")), "lang")
    out = named.join(labelled, (named["_name"] == labelled["name"]) & (named["_n"] == labelled["n"]), "left")
    return out.select(
        named["id"],
        *[named[c] for c in more],
        F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"),
        F.coalesce(1 / F.col("odds"), F.lit(0.0)).alias("score"),
        (-F.col("top")).alias("cross_entropy"),
        F.coalesce(F.col("top") < F.col("level"), F.lit(True)).alias("rejected"),
    )
