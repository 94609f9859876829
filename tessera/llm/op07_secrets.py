"""Secret scans with a random forest that removes false positives, in DataFrame functions alone.

Candidates are values assigned to a name that announces a secret, whatever they look like and also
behind blanks and quotes, and long runs of key characters with a digit. Each one gets features: its
length, its character transitions (letter to digit, digit to letter, lower to upper case, vowel next
to consonant), the share of its letters that dictionary words cover, whether it looks like a path,
and its neighbouring words (hashed): the last word before the candidate with its name, and the next
one behind it. The dictionary is the corpus's own: the DICTIONARY most frequent words.

The forest learns from labelled findings. A labelled table may be given; without one, evidence that
is not among the features labels findings: true are values of a well-known key format and values
assigned to a secret's name, false are e-mail addresses, network addresses, numbers, web addresses
and values assigned to other names; all others stay open. At most MAX_LABELLED findings (those with
the smallest MD5) are used, one in HELD_OUT of them only to measure the forest. Every candidate is
scored by the forest alone, and those under KEEP_AT are removed as false positives.

Defined results: null and empty texts have no findings; where candidates overlap the first one from
the left counts; where the labels are all of one kind the evidence's verdict stands and open
candidates are kept; a value with different labels is a true finding; repeated rows give repeated
findings, counted for their doc_id (null is one too); an empty table gives an empty result; other
columns are ignored. A text of any length is searched as a whole in one task, in time and memory in
proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash

#: Names that announce a secret, and formats of well-known keys.
SECRET_NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "access-key", "auth", "credential", "private_key", "private-key")
KNOWN = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35})$"

DICTIONARY = 1000
MAX_LABELLED = 20_000
HELD_OUT = 5
KEEP_AT = 0.5
#: Slots of the hashed neighbouring words.
NEIGHBOUR_SLOTS = 128
# Few places begin like a name; at the others the search goes on after one look.
_FIRST = "".join(sorted({c for n in SECRET_NAMES for c in (n[0], n[0].upper())}))
_NAMES = f"(?=[{_FIRST}])(?i:" + "|".join(SECRET_NAMES) + ")"
_KEY = "[A-Za-z0-9+/_=.@-]"
# Possessive runs keep the search linear in the text.
_ASSIGNED = _NAMES + r"[\w.-]{0,40}+[\"']?[\x20\x09-\x0D]{0,4}+(?::=|=>|=|:)[\x20\x09-\x0D]{0,4}+[\"'`(\[{<]*+"
_LONG = f"(?<!{_KEY})(?=[A-Za-z+/_=.@-]*+[0-9]){_KEY}{{12,}}+"
_CANDIDATE = _ASSIGNED + r"[^\x20\x09-\x0D\"'`,;)\]}<>]++|" + _LONG
_PREFIX = "^(?:" + _ASSIGNED + r"|[\w.-]*?=+(?=.))"
_BLANKS = r"[\x20\x09-\x0D]+"
FEATURES = ("length", "digits", "to_letter", "to_digit", "to_upper", "vowels", "covered", "path")


def dictionary(documents: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """word: the most frequent lower-case letter words of at least three letters over all texts, `size` rows."""
    words = documents.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where(F.length("word").between(3, 12))
    return words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(size).select("word")


def candidates(documents: DataFrame) -> DataFrame:
    """row, doc_id, begin, value, name, previous, next of every candidate.

    name is what the value is assigned to, null if it is not; previous and next are the neighbouring
    words of letters, lower-cased; row and begin tell candidates apart.
    """
    hinted = documents.select("doc_id", "text").where(F.col("text").rlike(_CANDIDATE)).withColumn("row", F.monotonically_increasing_id())
    cut = hinted.select("row", "doc_id", F.split("text", _CANDIDATE, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(_CANDIDATE), F.lit(0)).alias("found"))
    letters = lambda w: F.lower(F.regexp_replace(F.coalesce(w, F.lit("")), r"[^\p{L}]", ""))
    either = lambda a, b: F.when(letters(a) != "", letters(a)).otherwise(letters(b))

    def one(k: Column) -> Column:
        front, behind = F.split(F.element_at("gaps", k), _BLANKS), F.split(F.element_at("gaps", k + 1), _BLANKS, 4)
        at = lambda words, i: F.try_element_at(words, F.lit(i))
        last = F.when(at(front, -1) == "", either(at(front, -2), at(front, -3))).otherwise(either(at(front, -1), at(front, -2)))
        return F.struct(F.length(F.element_at("gaps", k)).alias("gap"), F.element_at("found", k).alias("text"), last.alias("previous"), F.when(letters(at(behind, 1)) != "", letters(at(behind, 1))).otherwise(either(at(behind, 2), at(behind, 3))).alias("next"))

    each = cut.select("row", "doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("found")), one)).alias("number", "c")).select("row", "doc_id", "number", "c.*")
    # All of one text's candidates: what lies in front of each one of them.
    front = F.sum(F.col("gap") + F.length("text")).over(Window.partitionBy("row").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)) - F.length("text")
    prefix = F.regexp_extract("text", _PREFIX, 0)
    placed = each.withColumns({"_front": front, "_prefix": prefix})
    value = F.rtrim(F.expr("substring(text, length(_prefix) + 1)"), F.lit(".,;:!?"))
    rows = placed.withColumns({"value": value, "name": F.when(F.col("_prefix") != "", F.lower("_prefix")), "begin": (F.col("_front") + F.length("_prefix")).cast("long")})
    return rows.where(F.col("value") != "").select("row", "doc_id", "begin", "value", "name", "previous", "next")


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds the FEATURES columns. found is a stashed table of candidates, words has a bounded number of rows."""
    v, n = F.col("value"), F.length("value").cast("double")
    share = lambda c: c.cast("double") / n
    count = lambda pattern: F.regexp_count(v, F.lit(pattern))
    letters = F.greatest(F.lit(1), F.length(F.regexp_replace(v, r"[^\p{L}]", "")))
    runs = found.select("row", "begin", F.explode(F.split(F.lower(v), r"[^\p{L}]+")).alias("word")).where(F.length("word") >= 3)
    known = runs.join(F.broadcast(words), "word").groupBy("row", "begin").agg(F.sum(F.length("word")).alias("_in_words"))
    return found.join(known, ["row", "begin"], "left").withColumns({
        "length": n,
        "digits": share(count("[0-9]")),
        "to_letter": share(count(r"[0-9](?=\p{L})")),
        "to_digit": share(count(r"\p{L}(?=[0-9])")),
        "to_upper": share(count(r"\p{Ll}(?=\p{Lu})")),
        "vowels": share(count("(?i)[aeiou](?=[b-df-hj-np-tv-z])")),
        "covered": F.coalesce(F.col("_in_words"), F.lit(0)).cast("double") / letters,
        "path": v.rlike(r"[/\\][^/\\]*[/\\]|^\.{0,2}/").cast("double"),
    }).drop("_in_words")


def evidence() -> Column:
    """1 true, 0 false, null open: what a finding's format and name tell, neither of which is a feature."""
    v = F.col("value")
    number = v.rlike(r"^[+(]?[0-9][0-9 ().,:/-]*$")
    address = v.rlike(r"^[^@]+@[^@]+\.[^@]+$|^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^[a-z]+://|^//")
    named = F.col("name").rlike(_NAMES)
    return F.when(v.rlike(KNOWN), 1).when(number | address, 0).when(named, 1).when(F.col("name").isNotNull(), 0).cast("double")


def labelled_sample(found: DataFrame, labelled: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """found with its label, and the bounded sample of one row for each labelled value."""
    if labelled is None:
        known = found.withColumn("label", evidence())
    else:
        given = labelled.groupBy("value_sha256").agg(F.max(F.col("label").cast("double")).alias("label"))
        known = found.join(given, "value_sha256", "left")
    # A value repeated all over the corpus is one finding to learn from.
    once = known.where(F.col("label").isNotNull()).groupBy("value_sha256").agg(F.max("label").alias("label"), F.min_by(F.struct(*FEATURES, "previous", "next"), F.struct("row", "begin")).alias("f"))
    return known, once.select("value_sha256", "label", "f.*").orderBy(F.md5("value_sha256"), "value_sha256").limit(MAX_LABELLED)


def fit_forest(sample: DataFrame, *, trees: int, depth: int, seed: int):
    """A pipeline that hashes the neighbouring words, assembles the features and applies the forest."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import FeatureHasher, VectorAssembler

    hasher = FeatureHasher(inputCols=["previous", "next"], outputCol="neighbours", numFeatures=NEIGHBOUR_SLOTS)
    assemble = VectorAssembler(inputCols=[*FEATURES, "neighbours"], outputCol="features")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, featureSubsetStrategy="0.5", seed=seed)
    return Pipeline(stages=[hasher, assemble, forest]).fit(sample)


def probability(model, found: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(found).withColumn("p", vector_to_array("probability")[1])


def described(documents: DataFrame) -> DataFrame:
    """All candidates with their features, as a stashed table."""
    found = stash(candidates(documents).withColumn("value_sha256", F.sha2("value", 256)))
    return stash(features(found, dictionary(documents)))


def held_out(documents: DataFrame, labelled: DataFrame | None = None, *, trees: int = 20, depth: int = 6, seed: int = 7) -> DataFrame:
    """precision, recall, findings of the forest on the labelled findings that it did not learn from."""
    _, sample = labelled_sample(described(documents), labelled)
    sample = stash(sample.withColumn("held", F.pmod(F.xxhash64("value_sha256"), F.lit(HELD_OUT)) == 0))
    model = fit_forest(sample.where("not held"), trees=trees, depth=depth, seed=seed)
    scored = probability(model, sample.where("held")).withColumn("kept", F.col("p") >= KEEP_AT)
    both, kept, true = (F.count(F.when(c, 1)) for c in (F.col("kept") & (F.col("label") == 1), F.col("kept"), F.col("label") == 1))
    return scored.agg((both / kept).alias("precision"), (both / true).alias("recall"), F.count("*").alias("findings"))


def scan(documents: DataFrame, labelled: DataFrame | None = None, *, trees: int = 20, depth: int = 6, seed: int = 7) -> DataFrame:
    """doc_id, begin, end, value_sha256, probability, kept of every candidate.

    labelled: (value_sha256, label) findings; None labels by evidence.
    """
    found = described(documents)
    known, sample = labelled_sample(found, labelled)
    sample = stash(sample.where(F.pmod(F.xxhash64("value_sha256"), F.lit(HELD_OUT)) != 0))
    rest = ["doc_id", "begin", (F.col("begin") + F.length("value")).alias("end"), "value_sha256"]
    if sample.select("label").distinct().count() < 2:
        verdict = F.coalesce(F.col("label"), F.lit(1.0))
        return known.select(*rest, verdict.alias("probability"), (verdict >= KEEP_AT).alias("kept"))
    scored = probability(fit_forest(sample, trees=trees, depth=depth, seed=seed), found)
    return scored.select(*rest, F.round("p", 6).alias("probability"), (F.col("p") >= KEEP_AT).alias("kept"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_candidates, n_secrets, spans (begin:end of the kept ones, in order)."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(documents)
    span = F.when(F.col("kept"), F.struct("begin", "end"))
    text = F.array_join(F.transform(F.sort_array(F.filter(F.collect_list(span), lambda s: s.isNotNull())), lambda s: F.concat_ws(":", s["begin"], s["end"])), ",")
    by_document = found.groupBy(F.col("doc_id").alias("_d")).agg(F.count("*").alias("n_candidates"), F.count(F.when(F.col("kept"), 1)).alias("n_secrets"), text.alias("spans"))
    joined = documents.select("doc_id").join(by_document, F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    return joined.select("doc_id", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("n_secrets", F.lit(0)).alias("n_secrets"), F.coalesce("spans", F.lit("")).alias("spans"))
