"""Posting text: boilerplate, labelled fields, gazetteer mentions, fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import WORD_CHAR, WS, as_col, let, squeeze, strip
from ..sources.tables import settle

# --- boilerplate -----------------------------------------------------------------------------------


def clean_text(text: Column | str, phrases: Sequence[str] = fixed.BOILERPLATE) -> Column:
    """Text without everything from a boilerplate phrase on, with newlines and spaces collapsed."""
    c = as_col(text)
    for phrase in phrases:
        c = F.regexp_replace(c, f"(?is){phrase}.*", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, " {2,}", " ")
    return strip(c)


def clean_postings(df: DataFrame, text: str = "description",
                   phrases: Sequence[str] = fixed.BOILERPLATE) -> DataFrame:
    """Adds ``clean`` and ``removed_chars``."""
    cleaned = df.withColumn("clean", clean_text(text, phrases))
    return cleaned.withColumn("removed_chars", F.length(text) - F.length("clean"))


def boilerplate_stats(df: DataFrame, source: str, text: str = "description",
                      phrases: Sequence[str] = fixed.BOILERPLATE) -> DataFrame:
    """Per source and phrase: texts that hold it, and the characters from its first place on.

    Each text yields at most one row per phrase and the counts combine before the shuffle.
    """
    hits = F.array_compact(F.array(*[
        F.when(F.length(F.regexp_extract(text, f"(?is){p}.*", 0)) > 0,
               F.struct(F.lit(p).alias("phrase"),
                        F.length(F.regexp_extract(text, f"(?is){p}.*", 0)).alias("chars")))
        for p in phrases
    ]))
    return (
        df.select(source, F.inline(hits)).groupBy(source, "phrase")
        .agg(F.count(F.lit(1)).alias("texts"), F.sum("chars").alias("removed_chars"))
    )


# --- labelled fields ---------------------------------------------------------------------------------


def ladder_value(text: Column, patterns: Sequence[str]) -> Column:
    """First pattern whose collapsed group 1 is longer than one character wins."""
    values = [squeeze(strip(F.regexp_extract(text, "(?d)" + p, 1))) for p in patterns]
    return F.coalesce(*[F.when(F.length(v) > 1, v) for v in values])


def extract_fields(df: DataFrame, text: str = "description",
                   ladders: Mapping[str, Sequence[str]] = fixed.POSTING_LADDER) -> DataFrame:
    """One column per field and ``found_fields``, the names of the fields that were found."""
    out = df.select("*", *[ladder_value(F.col(text), p).alias(name) for name, p in ladders.items()])
    found = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in ladders]))
    return out.withColumn("found_fields", found)


def fill_rates(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, filled, rows, rate) from one aggregate."""
    sums = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f)).alias(f) for f in fields])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields])
    return sums.select("rows", F.inline(cells)).select(
        "field", "filled", "rows", F.try_divide("filled", "rows").alias("rate"))


# --- gazetteer -------------------------------------------------------------------------------------------


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_CHAR + "+"), F.lit(0))


def first_mentions(docs: DataFrame, names: DataFrame, key: str, text: str, name: str = "name",
                   chars: int | None = None) -> DataFrame:
    """(key, name): the dictionary name mentioned earliest, the longer one on a tie.

    Only words that begin a name go on, each with the words that follow it up to the longest
    name; names may have any number of words. ``chars`` looks at the head of each text only.
    """
    phrase = _words(F.col(name))
    known = names.select(F.col(name).alias("name"), F.array_join(phrase, " ").alias("phrase"),
                         F.get(phrase, F.lit(0)).alias("word"), F.size(phrase).alias("words"))
    known = known.filter("word is not null").groupBy("phrase", "word", "words").agg(F.min("name").alias("name"))
    longest = known.agg(F.max("words")).first()[0] or 0
    body = F.col(text) if chars is None else F.substring(text, 1, chars)
    places = let(_words(body), lambda ws: F.transform(ws, lambda w, i: F.struct(
        i.alias("pos"), w.alias("word"), F.concat(F.array_join(F.slice(ws, i + 1, longest), " "), F.lit(" ")).alias("ahead"))))
    hits = docs.select(key, F.inline(places)).join(known, "word").filter(
        F.startswith("ahead", F.concat("phrase", F.lit(" "))))
    return hits.groupBy(key).agg(
        F.min_by("name", F.struct("pos", -F.length("phrase"), "name")).alias("name"))


#: Letters of a word that the neighbourhood index looks at; a bound on its entries, not on what is found.
INDEXED = 8


def deletions(word: Column, most: int) -> Column:
    """The word's first letters with up to ``most`` of them left out, each form once.

    Words at a distance of at most ``most`` share a form: an edit costs either side one letter at most, and what an
    alignment shifts past the last indexed letter is made up for by the edits that shift it.
    """
    forms = F.array(F.substring(word, 1, INDEXED))
    fewer = lambda w: F.when(F.length(w) > 0, F.transform(
        F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))).otherwise(F.array())
    every = forms
    for _ in range(most):
        forms = F.array_distinct(F.flatten(F.transform(forms, fewer)))
        every = F.concat(every, forms)
    return F.array_distinct(every)


def near_words(words: DataFrame, firsts: DataFrame, most: int) -> DataFrame:
    """(word, first): of distinct words(word) those within ``allowed`` edits of a word of firsts(first, allowed).

    A symmetric-delete index: both sides list their forms, equal forms meet, and what meets is measured. A word has at
    most 37 forms at a distance of two, however long it is.
    """
    forms = lambda df, c: df.withColumn("form", F.explode(deletions(F.col(c), most)))
    met = forms(words.select("word"), "word").join(forms(firsts.select("first", "allowed"), "first"), "form")
    close = met.where((F.abs(F.length("word") - F.length("first")) <= F.col("allowed")) & (F.levenshtein("word", "first") <= F.col("allowed")))
    return close.select("word", "first").distinct()


def misspelt_mentions(docs: DataFrame, names: DataFrame, key: str, text: str, name: str = "name", distance: int = 2,
                      letters: int = 4) -> DataFrame:
    """(key, name): the dictionary name mentioned earliest, also with typing errors; then the nearest, the longer, the smaller.

    As many words as the name has are compared with it one by one, and their edit distances add up. A name may have one
    error for every ``letters`` of its characters and ``distance`` (at most 2) in all, so short names must be exact.

    The vocabulary of all texts, not the texts, meets the dictionary's first words in a neighbourhood index. A text then
    learns which of its words begin a name, and only those go on with the words behind them. Null and empty texts mention
    nothing; repeated keys count as one text each and give the earliest name of all.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    phrase = _words(F.col(name))
    known = names.select(F.col(name).alias("name"), phrase.alias("phrase"), F.get(phrase, F.lit(0)).alias("first"))
    known = known.where("first IS NOT NULL").groupBy("phrase", "first").agg(F.min("name").alias("name"))
    length = F.length(F.array_join("phrase", " "))
    known = known.withColumns({"length": length, "allowed": F.least(F.lit(distance), F.floor(length / letters).cast("int"))})
    longest = known.agg(F.max(F.size("phrase"))).first()[0] or 0
    firsts = known.groupBy("first").agg(F.max("allowed").alias("allowed"))

    own = docs.select(F.col(key).alias("k"), F.posexplode(_words(F.col(text))).alias("pos", "word"))
    near = settle(near_words(own.select("word").distinct(), firsts, distance))
    starts = own.join(near, "word").groupBy("k").agg(F.collect_set(F.struct("pos", "first")).alias("starts"))
    body = docs.select(F.col(key).alias("b"), F.col(text).alias("body"))
    wanted = starts.join(body, F.col("k").eqNullSafe(F.col("b"))).select("k", "starts", _words(F.col("body")).alias("ws"))
    places = F.transform("starts", lambda s: F.struct(s["pos"].alias("pos"), s["first"].alias("first"), F.slice(F.col("ws"), s["pos"] + 1, F.lit(longest)).alias("ahead")))
    met = wanted.select("k", F.inline(places)).join(known, "first").where(F.size("ahead") >= F.size("phrase"))
    edits = F.aggregate(F.zip_with(F.slice("ahead", F.lit(1), F.size("phrase")), "phrase", lambda x, y: F.levenshtein(x, y)), F.lit(0), lambda a, d: a + d)
    hits = met.withColumn("edits", edits).where("edits <= allowed")
    best = hits.groupBy("k").agg(F.min_by("name", F.struct("pos", "edits", -F.col("length"), "name")).alias("name"))
    return best.select(F.col("k").alias(key), "name")


def fill_from_gazetteer(df: DataFrame, orgs: DataFrame, places: DataFrame, key: str = "id",
                        text: str = "description", name: str = "name",
                        chars: int | None = None, distance: int = 0) -> DataFrame:
    """Fills null company and location from dictionaries; only rows with a gap are searched.

    ``chars=5000`` looks at the first 5,000 characters only; ``distance`` allows for typing errors in names.
    """
    for column, names in (("company", orgs), ("location", places)):
        gaps = df.filter(F.col(column).isNull()).select(key, text)
        if distance:
            head = gaps if chars is None else gaps.withColumn(text, F.substring(text, 1, chars))
            found = misspelt_mentions(head, names, key, text, name, distance)
        else:
            found = first_mentions(gaps, names, key, text, name, chars)
        found = found.withColumnRenamed("name", "_found")
        df = df.join(found, key, "left").withColumn(column, F.coalesce(column, "_found")).drop("_found")
    return df


# --- fingerprints ---------------------------------------------------------------------------------------


def fingerprint(text: Column | str) -> Column:
    """SHA-256 of the text in lower case without any whitespace; never null.

    Saying so keeps joins on it from hashing every text once more to filter nulls.
    """
    plain = F.regexp_replace(F.lower(F.coalesce(as_col(text), F.lit(""))), WS + "+", "")
    return F.coalesce(F.sha2(plain, 256), F.lit(""))


def dup_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """(fingerprint, keeper, copies): the smallest key of each group of equal texts."""
    return df.select(key, fingerprint(text).alias("fingerprint")).groupBy("fingerprint").agg(
        F.min(key).alias("keeper"), F.count(F.lit(1)).alias("copies"))
