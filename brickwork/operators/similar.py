"""Similarity joins of names by the share of letters that they have in common, in order.

Two texts of m and n letters score round(200 * L / (m + n)), L being the length
of their longest common subsequence. A score of ``least`` asks for L of
c * (m + n) or more, so each side loses few letters: a text is listed, for each
length a partner has, with all its subsequences that are long enough, and
two texts meet exactly in their common ones. The longest one in which they meet is
L, so no pair is compared, and what meets is what scores. Texts that would be
listed more than ``most_keys`` times meet the others in their rarest letters or
pairs of letters; where only the best match is wanted, they are searched in blocks
of the others.
"""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwork.functions.similarity import best_ratios, sorted_tokens, text_ratio
from brickwork.sources.workspace import written


def common(m: int, n: int, least: int) -> int:
    """The letters that texts of m and n letters need in common."""
    return math.ceil((least - 0.5) / 200 * (m + n) - 1e-9)


def partners(m: int, least: int) -> dict[int, int]:
    """For each length that a text similar to one of m letters can have: the letters they need in common."""
    out, n = {}, 1
    while n <= m or common(m, n, least) <= m:
        if common(m, n, least) <= min(m, n):
            out[n] = common(m, n, least)
        n += 1
    return out


def longest_listed(least: int, most_keys: int) -> int:
    """Texts up to this length are listed ``most_keys`` times at most."""
    m = 1
    while sum(math.comb(m + 1, k) for least_common in partners(m + 1, least).values() for k in range(m + 2 - least_common)) <= most_keys:
        m += 1
    return m


def _listed(texts: DataFrame, least: int, most: int, lengths: list[int], left: bool) -> DataFrame:
    """item, n, key: each text of up to ``most`` letters with both lengths of a pair (three digits each) and each subsequence that is long enough for it.

    Partners have one of ``lengths``. A common subsequence has the letters of the
    shorter text at most, and fewer where the lengths are equal, as equal texts are no pair.
    """

    @F.pandas_udf("array<string>")
    def keys(column: pd.Series) -> pd.Series:
        def of(t: str) -> list[str]:
            m, found, subsequences = len(t), [], {}
            for n, enough in partners(m, least).items():
                if n in lengths:
                    for k in range(m - min(n, m - (m == n)), m - enough + 1):
                        if k not in subsequences:
                            subsequences[k] = {"".join(c) for c in combinations(t, m - k)}
                        found += [(f"{m:03d}{n:03d}" if left else f"{n:03d}{m:03d}") + x for x in subsequences[k]]
            return found

        return column.map(of)

    return texts.where(F.col("n") <= most).select("item", "n", F.explode(keys("text")).alias("key"))


def _met(a: DataFrame, b: DataFrame, least: int, most: int, once: bool = False) -> DataFrame:
    """item, other, score: pairs of texts (item, text, n) of up to ``most`` letters that score ``least``; ``once``: ``b`` is ``a``, and pairs begin with the smaller item."""
    lengths = lambda df: [r.n for r in df.where(F.col("n") <= most).select("n").distinct().collect()]  # noqa: E731  up to ``most`` numbers
    x = _listed(a, least, most, of := lengths(b), True)
    y = _listed(b, least, most, of if once else lengths(a), False).select("key", F.col("item").alias("other"), F.col("n").alias("other_n"))
    met = x.join(y.hint("merge"), "key").where("item < other" if once else "item <> other")  # Spark takes the keys for as small as the texts, and would send them all to the driver
    met = met.groupBy("item", "other", (F.col("n") + F.col("other_n")).alias("letters")).agg((F.max(F.length("key")) - 6).alias("common"))
    score = F.bround(200 * F.col("common") / F.col("letters"), 0).cast("int")
    return met.select("item", "other", score.alias("score")).where(F.col("score") >= least)


def _by_rare_parts(a: DataFrame, b: DataFrame, least: int, most: int, salts: int) -> DataFrame:
    """text, other: pairs of which one has more than ``most`` letters.

    With L letters in common, texts of m and n letters share L letters and
    3L - m - n - 1 pairs of neighbours, so the rarest m - L + 1 letters (or as many
    neighbours) of both have one in common. Neighbours are used from 80 on,
    letters below. Only pairs of near lengths are compared; each part is dealt
    out over ``salts`` tasks.
    """
    c = (least - 0.5) / 200
    wide = 2 if least >= 80 else 1

    def parts(text: str) -> tuple:
        seen: dict[str, int] = {}
        out = []
        for q in {wide, 1} if len(text) <= 8 else {wide}:
            for i in range(len(text) - q + 1):
                gram = text[i : i + q]
                seen[gram] = seen.get(gram, 0) + 1
                out.append(f"{gram}{seen[gram]}")
        both = len(text) + math.ceil(len(text) * c / (1 - c) - 1e-9)
        shared = math.ceil((c if wide == 1 else 3 * c - 1) * both - (wide - 1) - 1e-9)
        return len(out) if len(text) <= 8 else len(out) - max(1, shared) + 1, out

    @F.pandas_udf("take int, parts array<string>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parts(x) for x in texts], columns=["take", "parts"])

    x, y = (t.select("text", "n", cut("text").alias("c")).select("text", "n", "c.*") for t in (a, b))
    counts = x.unionAll(y).select(F.explode("parts").alias("part")).groupBy("part").agg(F.count("*").alias("rank"))

    def rarest(df: DataFrame) -> DataFrame:
        ranked = df.select("text", "n", "take", F.explode("parts").alias("part")).join(counts.hint("merge"), "part").groupBy("text", "n", "take")
        firsts = F.slice(F.array_sort(F.collect_list(F.struct("rank", "part"))), 1, F.col("take"))["part"]
        return ranked.agg(firsts.alias("firsts")).select("text", "n", "firsts", F.explode("firsts").alias("part"))

    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as a number: few texts may make many pairs
    x = rarest(x).withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(salts)).cast("int")).repartition(tasks, "part", "salt")
    y = rarest(y).select("part", F.col("text").alias("other"), F.col("n").alias("other_n"), F.col("firsts").alias("other_firsts"))
    y = y.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    near = (F.least("n", "other_n") >= c * (F.col("n") + F.col("other_n")) - 1e-9) & (F.greatest("n", "other_n") > most)
    once = F.array_intersect("firsts", "other_firsts")[0] == F.col("part")  # a pair is met in the rarest part that it shares
    return x.join(y.hint("merge"), ["part", "salt"]).where(near & once).select("text", "other")


def _any(df: DataFrame, condition) -> bool:
    return not df.where(condition).limit(1).isEmpty()


def similar_texts(left: DataFrame, right: DataFrame, least: int, most_keys: int = 2000, salts: int = 8) -> DataFrame:
    """text, other, score: all pairs of different texts of two tables (column ``text``) that score ``least``, over 67, or more.

    Null and empty texts are like nothing. Every pair is there once, in both
    directions if both tables hold both texts.
    """
    most = longest_listed(least, most_keys)
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given as a number, so that few texts, which take long each, still go to many tasks
    a, b = (df.select("text").where("text <> ''").distinct().repartition(tasks, "text").withColumn("n", F.length("text")) for df in (left, right))
    short = _met(*(df.withColumn("item", F.col("text")) for df in (a, b)), least, most).withColumnRenamed("item", "text")
    if _any(right, F.length("text") > most) or _any(left, F.length("text") > most):
        long = _by_rare_parts(a, b, least, most, salts).where("text <> other")
        short = short.unionByName(long.withColumn("score", text_ratio("text", "other")).where(F.col("score") >= least))
    return short


def _with_text(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("text", F.pandas_udf(lambda names: names.map(sorted_tokens), "string")(name))


def similar_names(left: DataFrame, right: DataFrame, least: int, **options) -> DataFrame:
    """name, other_name, score: all pairs of the distinct names of two tables (column ``name``) with a token-sort score of ``least`` or more, equal ones too."""
    a, b = (_with_text(df.select("name").where("name IS NOT NULL").distinct(), "name").where("text <> ''") for df in (left, right))
    other = b.select(F.col("text").alias("other"), F.col("name").alias("other_name"))
    pairs = similar_texts(a, b, least, **options)
    equal = a.join(other, F.col("text") == F.col("other")).select("name", "other_name", F.lit(100).alias("score"))
    return a.join(pairs, "text").join(other, "other").select("name", "other_name", "score").unionByName(equal)


def _best_in_blocks(texts: DataFrame, known: DataFrame, least: int, most_left: int = 16_384, most_right: int = 65_536) -> DataFrame:
    """text, other, score: of ``known`` (other, right_id) the best for each text of up to 62 letters in each block of ``known``, if it scores ``least``; ties go to the smaller right id.

    Blocks of about ``most_left`` texts meet blocks of about ``most_right``
    others, whose common beginnings or endings are compared once.
    """
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = texts.count()
    rights = math.ceil(known.count() / most_right) or 1
    lefts = max(math.ceil(count / most_left), min(math.ceil(count / 512), math.ceil(4 * tasks / rights)), 1)
    of = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = texts.select("text", of("text", lefts).alias("i"), every(rights).alias("j")).repartition(tasks, "i", "j")
    no_id = F.col("right_id").isNull()
    y = known.select("other", no_id.alias("no_id"), F.coalesce("right_id", F.lit(0)).alias("right_id"), of("other", rights).alias("j"), every(lefts).alias("i")).repartition(tasks, "i", "j")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        others = b.sort_values(["no_id", "right_id"])["other"].tolist()
        place, score = best_ratios(a["text"].tolist(), others, least)
        return pd.DataFrame({"text": a["text"], "other": [others[k] if k >= 0 else None for k in place.tolist()], "score": score}).dropna(subset=["other"])

    return x.groupBy("i", "j").cogroup(y.groupBy("i", "j")).applyInPandas(best, "text string, other string, score int")


def _best_candidates(texts: DataFrame, known: DataFrame, least: int, most_keys: int = 2000, **options) -> DataFrame:
    """text, other, score: pairs with the best match of every text among ``known`` (other, right_id), if it scores ``least``.

    Texts that are listed meet in common subsequences, the others are searched in
    blocks, and left ones of over 62 letters meet in their rarest parts.
    """
    most, n, others = longest_listed(least, most_keys), F.length("text"), known.withColumnRenamed("other", "text")
    short, middle, long = n <= F.lit(min(most, 62)), (n > most) & (n <= 62), n > 62
    out = similar_texts(texts.where(short), others.where(n <= most), least, most_keys, **options)
    if _any(texts, middle):
        out = out.unionByName(_best_in_blocks(texts.where(middle), known, least))
    if _any(others, n > most) and _any(texts, short):
        out = out.unionByName(_best_in_blocks(texts.where(short), known.where(F.length("other") > most), least))
    if _any(texts, long):
        out = out.unionByName(similar_texts(texts.where(long), others, least, most_keys, **options))
    return out


def best_similar(left: DataFrame, left_id: str, left_name: str, right: DataFrame, right_id: str, right_name: str, least: int, step: int = 10, **options) -> DataFrame:
    """left_id, right_id, score: the best match of each row of ``left`` among the names of ``right``, if it scores ``least``; ties go to the smaller right id.

    Scores are looked for from the top down, ``step`` points at a time: what has a
    match is not looked for at lower scores, where more texts are alike. A row of
    ``right`` stands for each of its names (aliases), its best one counts.
    """
    a = written(_with_text(left.select(F.col(left_id).alias("id"), F.col(left_name).alias("name")).where("name IS NOT NULL"), "name").select("id", "text"), "names")
    b = written(_with_text(right.select(F.col(right_id).alias("right_id"), F.col(right_name).alias("name")).where("name IS NOT NULL"), "name").groupBy(F.col("text").alias("other")).agg(F.min("right_id").alias("right_id")), "others")
    texts, known = a.select("text").where("text <> ''").distinct(), b.where("other <> ''")
    found = [written(texts.join(b.hint("merge"), F.col("text") == F.col("other")).select("text", "right_id", F.lit(100).alias("score")), "equal")]
    for level in [*range(100 - step, least, -step), least]:
        texts = written(texts.join(found[-1].hint("merge"), "text", "left_anti"), "open")
        if texts.isEmpty():
            break
        best = _best_candidates(texts, known, level, **options).join(b.hint("merge"), "other")
        best = best.groupBy("text").agg(F.max_by(F.struct("right_id", "score"), F.struct("score", -F.col("right_id"))).alias("b")).select("text", "b.*")
        found.append(written(best, "best"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return a.join(every.hint("merge"), "text").select(F.col("id").alias(left_id), F.col("right_id").alias(right_id), "score")


def duplicate_names(df: DataFrame, id_col: str, name_col: str, least: int, most_keys: int = 2000, salts: int = 8) -> tuple[DataFrame, DataFrame]:
    """Candidates for review: (pairs of representatives: id, other, score) and (members: id, representative).

    Rows whose names have the same words are one class, its least id represents
    it, so a name that occurs a million times is one text and no pairs of its own.
    """
    rows = written(_with_text(df.select(F.col(id_col).alias("id"), F.col(name_col).alias("name")).where("name IS NOT NULL"), "name").where("text <> ''").select("id", "text"), "names")
    first = written(rows.groupBy("text").agg(F.min("id").alias("representative")), "classes")
    members = rows.join(first.hint("merge"), "text").select("id", "representative")
    most = longest_listed(least, most_keys)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as a number, as above
    shared = not first.groupBy("representative").count().where("count > 1").isEmpty()  # one id with several names
    item = F.struct("representative", "text") if shared else F.col("representative")
    of = lambda end: (F.col(end)["representative"] if shared else F.col(end))
    texts = first.select(item.alias("item"), "text", F.length("text").alias("n")).repartition(tasks, "item")
    pairs = _met(texts, texts, least, most, once=True).select(of("item").alias("id"), of("other").alias("other"), "score")
    if _any(texts, F.col("n") > most):
        long = _by_rare_parts(texts, texts, least, most, salts).where("text < other")
        long = long.withColumn("score", text_ratio("text", "other")).where(F.col("score") >= least)
        ends = long.join(first.withColumnRenamed("representative", "a").hint("merge"), "text").join(first.select(F.col("text").alias("other"), F.col("representative").alias("b")).hint("merge"), "other")
        pairs = pairs.unionByName(ends.select(F.least("a", "b").alias("id"), F.greatest("a", "b").alias("other"), "score"))
    return pairs.where("id < other"), members
