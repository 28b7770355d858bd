"""Names in text and near names, as equi joins: no all-pairs comparison anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgrid.functions.columns import NO_WORD


def phrase_key(text: Column) -> Column:
    """Lower-case words of a name, joined by single spaces; null for a name without words."""
    key = F.trim(F.regexp_replace(F.lower(text), NO_WORD, " "))
    return F.when(key != "", key)


def word_list(text: Column) -> Column:
    """All words of a whole text, lower-case and in order."""
    return F.filter(F.split(F.lower(text), NO_WORD), lambda w: w != "")


def term_hits(texts: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, term_id) for every term named in the whole text.

    `terms` holds term_id and phrase, of any number of words in any script. Each place of a text meets the terms by their first word, in an
    equi join, and the words after it are compared there; a place carries no more words than the longest term has. Spark broadcasts the terms where
    they are small and shuffles by first word otherwise.
    """
    wanted = terms.select("term_id", word_list(F.col("phrase")).alias("_term")).filter(F.size("_term") > 0).distinct()
    longest = wanted.agg(F.max(F.size("_term")).alias("n")).scalar()
    listed = texts.select(key, word_list(F.col(text)).alias("_words"), longest.alias("_longest"))
    places = listed.select(key, "_words", "_longest", F.posexplode("_words").alias("_at", "_first"))
    places = places.select(key, "_first", F.slice("_words", F.col("_at") + 1, F.col("_longest")).alias("_run"))
    hits = places.join(wanted.withColumn("_first", F.col("_term")[0]), "_first").filter(F.slice("_run", 1, F.size("_term")) == F.col("_term"))
    return hits.select(key, "term_id").distinct()


def deletion_variants(name: Column, distance: int) -> Column:
    """The name and all forms of it with up to `distance` letters left out."""
    forms = F.array(name)
    for _ in range(distance):
        forms = F.array_distinct(F.concat(forms, F.flatten(F.transform(
            forms,
            lambda s: F.transform(
                F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>")),
                lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))),
            ),
        ))))
    return forms


def near_names(left: DataFrame, right: DataFrame, distance: int = 1) -> DataFrame:
    """Pairs of different names within an edit distance.

    Two names within a distance share a form with that many letters left out, so the join on such
    forms finds every pair and the edit distance is computed for those only. Names are distinct
    first: copies of one name cost one row.
    """
    l = left.select(F.col("name").alias("left_name")).filter(F.col("name").isNotNull()).distinct()
    r = right.select(F.col("name").alias("right_name")).filter(F.col("name").isNotNull()).distinct()
    lv = l.select("left_name", F.explode(deletion_variants(F.col("left_name"), distance)).alias("_form"))
    rv = r.select("right_name", F.explode(deletion_variants(F.col("right_name"), distance)).alias("_form"))
    pairs = lv.join(rv, "_form").filter(F.col("left_name") != F.col("right_name")).select("left_name", "right_name").distinct()
    return pairs.withColumn("distance", F.levenshtein("left_name", "right_name", distance)).filter(F.col("distance") >= 0)


#: Share of a longer name's letters that may differ between two names that share a rare word.
NEAR_SHARE = 0.25


def similar_names(left: DataFrame, right: DataFrame, share: float = NEAR_SHARE) -> DataFrame:
    """Pairs of different names, left_name and right_name, that are likely one: distance, and score as one less its share of the longer name.

    Two names are near if they share a word that is the rarest of one of them and differ in no more letters than `share` of the longer
    one, or if they differ in one letter anywhere. How rare a word is, the right side's names tell; of equally rare ones the first in order counts. Both
    sides fold to distinct names. A name meets only names of a fitting length that hold its rarest word, or whose rarest word it holds, so a word
    that most names share brings no names together.
    """
    l = left.select(F.col("name").alias("left_name")).filter(F.col("name").isNotNull()).distinct()
    r = right.select(F.col("name").alias("right_name")).filter(F.col("name").isNotNull()).distinct()

    def words(df: DataFrame, name: str) -> DataFrame:
        return df.select(name, F.explode(F.array_distinct(F.split(name, " "))).alias("_word"))

    known = words(r, "right_name")
    common = known.groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))

    def rarest(rows: DataFrame, name: str) -> DataFrame:
        ranked = rows.join(common, "_word", "left").groupBy(name).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_word")).alias("_r"))
        return ranked.select(name, F.col("_r._word").alias("_word"))

    asked = words(l, "left_name")
    size = F.length("left_name")
    spans = F.explode(F.sequence(F.ceil(size * (1 - share)).cast("int"), F.floor(size / (1 - share)).cast("int"))).alias("_size")

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.select("left_name", "_word", spans).join(b.withColumn("_size", F.length("right_name")), ["_word", "_size"]).select("left_name", "right_name")

    shared = meet(rarest(asked, "left_name"), known).unionByName(meet(asked, rarest(known, "right_name"))).distinct().filter(F.col("left_name") != F.col("right_name"))
    longer = F.greatest(F.length("left_name"), F.length("right_name"))
    shared = shared.withColumn("distance", F.levenshtein("left_name", "right_name")).filter(F.col("distance") <= F.floor(longer * share))
    pairs = shared.unionByName(near_names(l.select(F.col("left_name").alias("name")), r.select(F.col("right_name").alias("name")), 1)).distinct()
    return pairs.withColumn("score", F.lit(1.0) - F.col("distance") / longer)
