"""Quality rules: fixed base rules, then a decision list learned from labelled statistics. DataFrame functions only.

Learning is sequential covering. Thresholds are quantiles of each statistic; a rule is a conjunction of at most
MAX_CONDITIONS threshold conditions, grown by information gain on two thirds of the labelled rows and pruned from its end
on the other third; an accepted rule's rows leave, and the next rule is learned on the rest. Every count is a Spark
aggregate over the labelled rows' bins. The list is emitted as one conditional expression.

Cases: null and empty texts have no words, so they fail the base rules; repeated rows are judged alike; without labels, or
with labels of one class, no rule is learned and the base rules decide; an empty table gives an empty result; other columns
are ignored. A label row counts once per document row with its doc_id; of several labels of a doc_id the smallest counts;
labels that are null, or of a null doc_id, are ignored; rows with one doc_id or none are judged each by its own text; very
long texts are taken whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import SPACE_CLASS, stage

SYMBOLS = "#*$%&|<>"
#: At most about this many labelled rows are learned from (chosen by a hash of doc_id).
LABELLED = 60_000
CUTS = 24
MAX_CONDITIONS, MAX_RULES = 3, 12
LEAST_SUPPORT, LEAST_PRECISION = 8, 0.9
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"


def _count(chars: str) -> Column:
    """How many of these characters the text has."""
    return F.regexp_count("text", F.lit(f"[{chars}]"))


def statistics(docs: DataFrame, extra: bool = False, carry: bool = False) -> DataFrame:
    """doc_id, the base statistics and the ratios that rules are learned on.

    With extra also those of a finer profile; with carry also the whole row as the struct _row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = ["_row"] if carry else []
    whole = [F.struct(*[docs[c] for c in docs.columns]).alias("_row")] if carry else []
    a = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *whole).select("doc_id", *row, "text", F.array_remove(F.split("text", SPACE_CLASS), "").alias("words")).select(
        "doc_id", *row, "words", F.length(F.array_join("words", "")).alias("word_chars"), _count(SYMBOLS).alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
        _count(_UPPER).alias("n_upper"), _count("!?").alias("n_marks"), _count("0123456789").alias("n_digits"), _count(".,;:").alias("n_stops"),
    )
    # each word is hashed once; a window is told by its eight words' hashes
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_words") - 8, F.lit(0))), lambda i: F.xxhash64(*[F.get("word_hashes", i + k) for k in range(8)]))
    b = a.withColumn("n_words", F.size("words")).withColumn("word_hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn(
        "h", F.when(F.col("n_words") >= 8, windows).otherwise(F.array().cast("array<bigint>"))
    ).withColumn("twice", F.size(F.array_distinct("h")) < F.size("h"))
    # windows found twice, in order of their hash, give the places that are covered
    c = b.withColumn("sorted", F.when(F.col("twice"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda k, o: F.coalesce(F.get("sorted", k + o)["h"] == F.get("sorted", k)["h"], F.lit(False))
    d = c.withColumn(
        "starts",
        F.when(F.col("twice"), F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), lambda k: same(k, 1) | ((k > 0) & same(k, -1))), lambda k: F.get("sorted", k)["i"]))),
    )
    covered = F.aggregate("starts", F.struct(F.lit(-8).alias("last"), F.lit(0).alias("sum")), lambda acc, s: F.struct(s.alias("last"), (acc["sum"] + F.least(F.lit(8), s - acc["last"])).alias("sum")))["sum"]
    per = lambda x, n: F.coalesce(F.try_divide(x.cast("double"), n.cast("double")), F.lit(0.0))
    n_words = F.col("n_words")
    distinct = F.size(F.array_distinct("words"))
    out = d.select(
        "doc_id", *row, n_words.cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        per(F.col("word_chars"), n_words).alias("f_word_length"), per(F.col("n_symbols"), n_words).alias("f_symbols"),
        per(F.size("lines") - F.size(F.array_distinct("lines")), F.size("lines")).alias("f_dup_lines"), per(F.coalesce(covered, F.lit(0)), n_words).alias("f_repeats"),
        per(F.col("n_upper"), F.col("word_chars")).alias("f_upper"), per(F.col("n_marks"), n_words).alias("f_marks"),
        per(distinct, n_words).alias("f_distinct"), per(n_words, F.size("lines")).alias("f_line_words"), per(F.col("n_stops"), n_words).alias("f_stops"),
        *([per(F.col("n_digits"), n_words).alias("f_digits"), F.log1p(n_words.cast("double")).alias("f_log_words"), F.log1p(per(distinct, F.sqrt(n_words.cast("double")))).alias("f_variety")] if extra else []),
    )
    return out


FEATURES = ["f_word_length", "f_symbols", "f_dup_lines", "f_repeats", "f_upper", "f_marks", "f_distinct", "f_line_words", "f_stops"]


def chosen_labels(labels: DataFrame, label: str, most: int = LABELLED) -> DataFrame:
    """doc_id and y (1: the label) of at most about `most` labelled ids."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("y").alias("y"))
    total = own.count()
    share = min(1.0, most / total) if total else 1.0
    return own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))


def labelled(stats: DataFrame, labels: DataFrame, label: str, most: int = LABELLED) -> DataFrame:
    """Statistics of labelled rows with y."""
    return stats.join(chosen_labels(labels, label, most), "doc_id")


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else -1.0


def learn(stats: DataFrame, labels: DataFrame, label: str = "quality") -> list[list[tuple[str, str, float]]]:
    """Ordered rules, each a list of (statistic, ">" or "<=", threshold), that find rows whose label is 0."""
    return covered(labelled(stats, labels, label), FEATURES)


def covered(rows: DataFrame, features: list[str]) -> list[list[tuple[str, str, float]]]:
    """The rules of sequential covering over rows with doc_id, y and the features."""
    rows = stage(rows.select("doc_id", "y", *features), "labelled")
    cuts_of = rows.agg(*[F.percentile_approx(f, [(i + 0.5) / CUTS for i in range(CUTS)], 2000).alias(f) for f in features]).first()
    cuts = {f: sorted({float(x) for x in cuts_of[f]}) if cuts_of[f] else [] for f in features}
    # the bin of a value: how many cuts lie below it, so value > cuts[i] is bin > i
    place = lambda f: sum([(F.col(f) > c).cast("int") for c in cuts[f]], F.lit(0)).alias(f)
    binned = rows.select((F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) > 0).alias("grow"), (F.col("y") == 0).alias("bad"), *[place(f) for f in features])
    binned = stage(binned.groupBy("grow", "bad", *features).agg(F.count(F.lit(1)).alias("n")), "bins")

    def holds(rule):
        out = F.lit(True)
        for f, op, i in rule:
            out = out & (F.col(f) > i if op == ">" else F.col(f) <= i)
        return out

    def counts(where: Column) -> dict:
        """(feature, bin) -> (bad, good) among the growing rows."""
        long = binned.where(F.col("grow") & where).select("bad", "n", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("i")) for f in features])).alias("x"))
        got = long.groupBy("x.f", "x.i").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(~F.col("bad"), F.col("n")).otherwise(0)).alias("q"))
        return {(r.f, r.i): (r.p, r.q) for r in got.collect()}  # at most features * (CUTS + 1) rows

    rules: list[list[tuple[str, str, int]]] = []
    rest = F.lit(True)
    for _ in range(MAX_RULES):
        rule: list[tuple[str, str, int]] = []
        while len(rule) < MAX_CONDITIONS:
            table = counts(rest & holds(rule))
            totals = [tuple(sum(table.get((f, i), (0, 0))[k] for i in range(len(cuts[f]) + 1)) for k in (0, 1)) for f in features[:1]][0]
            if totals[0] < LEAST_SUPPORT or not totals[1]:
                break
            best = (1e-6, None)
            for f in features:
                p = q = 0
                for i in range(len(cuts[f])):  # the condition <= i, and its complement
                    p, q = p + table.get((f, i), (0, 0))[0], q + table.get((f, i), (0, 0))[1]
                    best = max(best, (_gain(p, q, *totals), (f, "<=", i)), (_gain(totals[0] - p, totals[1] - q, *totals), (f, ">", i)), key=lambda x: x[0])
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        sums = []
        for k in range(1, len(rule) + 1):
            for name, bad in (("p", True), ("q", False)):
                sums.append(F.sum(F.when(holds(rule[:k]) & (F.col("bad") == bad), F.col("n")).otherwise(0)).alias(f"{name}{k}"))
        got = binned.where(~F.col("grow") & rest).agg(*sums).first()
        worth = [((got[f"p{k}"] or 0) - (got[f"q{k}"] or 0)) / max(1, (got[f"p{k}"] or 0) + (got[f"q{k}"] or 0)) for k in range(1, len(rule) + 1)]
        k = max(range(len(rule)), key=lambda i: worth[i]) + 1
        p, q = got[f"p{k}"] or 0, got[f"q{k}"] or 0
        if p + q < LEAST_SUPPORT // 2 or p < LEAST_PRECISION * (p + q):
            break
        rules.append(rule[:k])
        rest = rest & ~holds(rule[:k])
    return [[(f, op, cuts[f][i]) for f, op, i in rule] for rule in rules]


def expression(rules: list[list[tuple[str, str, float]]]) -> Column:
    """true: kept. The first rule that holds rejects."""
    out = None
    for rule in rules:
        holds = F.lit(True)
        for f, op, x in rule:
            holds = holds & (F.col(f) > x if op == ">" else F.col(f) <= x)
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, base statistics, base_failed and kept of each row."""
    stats = stage(statistics(docs), "statistics")
    rules = learn(stats, labels)
    return stats.select("doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & expression(rules)).alias("kept"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep: learned from the labelled rows, then applied where each row lies."""
    # the chosen labels are bounded by LABELLED, so the texts need not move
    ids = F.broadcast(chosen_labels(labels, "quality"))
    rules = covered(statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids.select("doc_id"), "doc_id", "left_semi")).join(ids, "doc_id"), FEATURES)
    # the statistics come out of a generator: a filter on them stays above it, where each is computed once, instead of being
    # pushed down and computed again in every place that names it
    found = statistics(docs, carry=True)
    held = found.select("_row", F.explode(F.array(F.struct(*BASE, *FEATURES))).alias("_s")).select("_row", "_s.*")
    return held.where(~base_failed() & expression(rules)).select("_row.*")
