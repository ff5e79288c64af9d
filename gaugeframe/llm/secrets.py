"""Secret scan with a random forest against false positives (operator 10), native.

Regular expressions mark candidates: values assigned to a credential word or an authorization
header, private key blocks, keys of known shape (prefixes of providers, JSON web tokens), and
runs of token characters that hold a digit. Each candidate gets features by SQL functions: length,
character classes and their transitions, entropy, the share of its letter triples that occur
in dictionary words, whether it is part of a path, and the words around it. A Spark ML random
forest trained from labelled findings tells secrets from false positives. Everything runs in
the JVM.

Labelled findings are a table of the candidates' features with ``label`` (1 secret, 0 not).
Where nobody has labelled any, ``weak_labels`` marks a bounded sample of the candidates
(``FINDINGS`` rows of smallest hash). Evidence of a secret is an assignment to a credential word,
a key block or known shape, a credential word told just before, or a random value; digests,
ids, paths, embedded data and plain numbers are none by themselves. A placeholder is told by the
value itself; words around it (``placeholder_near``) are a feature and decide no label. What this evidence calls a
secret is reported whatever the forest, which has seen the sample only, says of it: the forest
adds candidates that resemble secrets. With given labels the forest alone decides. The dictionary is the ``DICTIONARY`` most frequent
words around the candidates of that sample.

Nulls and empty texts have no candidates. Candidates that repeat are findings each. If the
labelled findings hold one class only, no forest can be trained and the candidates' own weak
label decides. Rows are told apart by an internal number, so ids may be null or repeat. Texts
are scanned whole. An empty table has no findings. Redaction keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeframe.llm.data import read
from gaugeframe.session import materialize

FINDINGS = 20_000
DICTIONARY = 2_000
TREES = 40
DEPTH = 6
ACCEPT = 0.5
REDACTED = "[SECRET]"
BEFORE, AFTER = 80, 40

CREDENTIAL = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth)"
ASSIGNED = rf"""(?:{CREDENTIAL}|(?i:authorization))["']?\s{{0,3}}[:=]\s{{0,3}}["']?(?:(?i:bearer|basic)\s{{1,3}})?"""
TOKEN = "A-Za-z0-9+/=_-"
# A block up to its end mark; without one, the header and the lines of text code after it.
KEY_BLOCK = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY[A-Z ]{0,9}-----"
    r"(?:[\s\S]{1,16000}?-----END [A-Z ]{0,20}PRIVATE KEY[A-Z ]{0,9}-----|(?:(?:\s|\\[nr]){0,8}+[A-Za-z0-9+/=]{40,}+){1,200}+)"
)
SHAPE = (
    r"(?:(?:AKIA|ASIA|ABIA|ACCA|AROA|AIDA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{30,}+|github_pat_[A-Za-z0-9_]{22,}+"
    r"|glpat-[A-Za-z0-9_-]{20,}+|[sr]k[_-](?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+|xox[abeoprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35}"
    r"|SG\.[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{16,}+|hf_[A-Za-z0-9]{30,}+|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{50,}+|ya29\.[A-Za-z0-9_-]{20,}+"
    r"|eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{0,9999}+){2,4}+)"
)
CANDIDATE = (
    rf"""({ASSIGNED})({KEY_BLOCK}|[^\s"']{{8,}}+)"""
    rf"""|({KEY_BLOCK}|(?<![A-Za-z0-9]){SHAPE}|(?<![{TOKEN}])(?=[A-Za-z+/=_-]*+[0-9])[{TOKEN}]{{16,}}+)"""
)
# Words right before a candidate, at most two others between.
BETWEEN = r"\W{0,3}(?:\w{1,20}\W{1,3}){0,2}$"
TOLD = rf"(?i)(?<![a-z])(?:passwords?|passwd|pwd|secrets?|tokens?|(?:api|access|private|secret)[ _-]?keys?|credentials?|bearer){BETWEEN}"
DIGEST_TOLD = rf"(?i)(?<![a-z])(?:sha-?\d{{0,3}}|md5|checksum|digest|commit|revision|uuid|guid|hash|etag|integrity){BETWEEN}"
UUID = r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$"
WORDLIKE = "[A-Za-z][a-z]{3,}"
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test|fake|redacted|0000000|1234567"
# A value that is a placeholder as a whole or has such a word in it, set off by other signs.
PLACEHOLDER_VALUE = (
    r"(?i)(?:^|[^a-z0-9])(?:examples?|samples?|dummy|placeholder|change[_-]?me|your|test|testing|fake|redacted|[x*]{4,})\d{0,4}(?:$|[^a-z0-9])"
    r"|^(?:\W|_)*(?:(.)\1*|0?1234567(?:89?0?)?)(?:\W|_)*$|(?-i:EXAMPLE(?:KEY)?$)"
)
# Its second word is the provider's, not the value's.
TEST_KEY = "^([sr]k)[_-]test[_-]"
DIGEST = r"(?i)sha-?\d*|md5|checksum|digest|commit|uuid|guid|hash"
# A mark no text holds: the first character is doubled with another one wherever a text has it.
ESCAPE, MARK, ESCAPED = "", "", ""

FEATURES = (
    "length", "digits", "uppers", "lowers", "others", "transitions", "hex", "entropy", "coverage", "in_path",
    "assigned", "credential_near", "placeholder_near", "digest_near", "quoted", "words_near",
    "shape", "told", "digest_told", "uuid", "data", "wordlike", "placeholder",
)


def marked(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with candidates, numbered (_row) and split at them (_parts: every second part is one)."""
    held = F.regexp_replace(F.replace(F.col(text), F.lit(ESCAPE), F.lit(ESCAPED)), CANDIDATE, f"$1{MARK}$2$3{MARK}")
    parts = F.transform(F.split(held, MARK), lambda s: F.replace(s, F.lit(ESCAPED), F.lit(ESCAPE)))
    split = docs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_parts", parts)
    return split.where(F.size("_parts") > 1)


def has_candidate(text: Column) -> Column:
    return F.coalesce(text.rlike(CANDIDATE), F.lit(False))


def candidates(parts: DataFrame, keep: list[str]) -> DataFrame:
    """One row per candidate of a stored ``marked`` table: place, text, and what stands around it."""
    short = F.transform(
        "_parts",
        lambda s, i: F.struct(
            F.length(s).alias("n"), F.when(i % 2 == 1, s).alias("own"), F.right(s, F.lit(BEFORE)).alias("tail"), F.left(s, F.lit(AFTER)).alias("head")
        ),
    )
    rows = parts.select(*keep, "_row", F.posexplode(short).alias("part", "p"))
    order = Window.partitionBy("_row").orderBy("part")
    rows = rows.select(
        *keep, "_row", "part", F.col("p.own").alias("finding"), F.col("p.n").alias("length"),
        (F.sum("p.n").over(order) - F.col("p.n")).alias("start"),
        F.lag("p.tail").over(order).alias("before"), F.lead("p.head").over(order).alias("after"),
    )
    return rows.where("part % 2 = 1")


def dictionary(sample: DataFrame) -> list[str]:
    """The most frequent words around the candidates of a bounded sample."""
    near = sample.select(F.explode(F.split(F.lower(F.concat_ws(" ", "before", "after")), r"[^\p{L}]+")).alias("w"))
    counted = near.where(F.length("w") >= 3).groupBy("w").count().orderBy(F.desc("count"), "w").limit(DICTIONARY)
    return [r.w for r in counted.collect()]


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    """Adds the columns ``FEATURES`` as doubles."""
    c, n = F.col("finding"), F.greatest(F.col("length"), F.lit(1)).cast("double")
    triples = sorted({w[i : i + 3] for w in words for i in range(len(w) - 2)}) or [""]
    letters = F.regexp_replace(F.lower(c), r"[^\p{L}]", " ")
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.col("length") - 2, F.lit(1))), lambda i: F.substring(letters, i, F.lit(3)))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    singles = F.array_distinct(F.split(c, ""))

    def share(ch):
        return (F.length(c) - F.length(F.replace(c, ch, F.lit("")))) / n

    entropy = F.aggregate(singles, F.lit(0.0), lambda total, ch: total - F.when(share(ch) > 0, share(ch) * F.log2(share(ch))).otherwise(0.0))
    near = F.concat_ws(" ", "before", "after")
    columns = {
        "digits": F.regexp_count(c, F.lit("[0-9]")) / n,
        "uppers": F.regexp_count(c, F.lit("[A-Z]")) / n,
        "lowers": F.regexp_count(c, F.lit("[a-z]")) / n,
        "others": F.regexp_count(c, F.lit("[^A-Za-z0-9]")) / n,
        "transitions": F.regexp_count(classes, F.lit(r"(.)(?!\1|$)")) / n,
        "hex": c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "entropy": entropy,
        "coverage": F.size(F.filter(pieces, lambda t: t.isin(triples))) / F.size(pieces),
        "in_path": F.col("before").rlike(r"[/\\.@]$") | F.col("after").rlike(r"^[/\\.@]\S"),
        "assigned": F.col("before").rlike(rf"{ASSIGNED}$"),
        "credential_near": F.col("before").rlike(CREDENTIAL),
        "placeholder_near": F.concat(F.right("before", F.lit(24)), c).rlike(PLACEHOLDER),
        "digest_near": F.col("before").rlike(DIGEST),
        "quoted": F.col("before").rlike("[\"'`]$"),
        "words_near": F.regexp_count(near, F.lit(r"\p{L}{3,}")),
        "shape": c.rlike(rf"^{KEY_BLOCK}|(?<![A-Za-z0-9]){SHAPE}"),
        "told": F.col("before").rlike(TOLD),
        "digest_told": F.col("before").rlike(DIGEST_TOLD) | c.rlike(r"(?i)^(?:sha-?\d{1,3}|md5)[-_=:]"),
        "uuid": c.rlike(UUID),
        "data": F.col("before").rlike(r"base64,\s{0,3}$"),
        "wordlike": (F.length(c) - F.length(F.regexp_replace(c, WORDLIKE, ""))) / n,
        "placeholder": F.regexp_replace(c, TEST_KEY, "$1_").rlike(PLACEHOLDER_VALUE),
        "length": F.col("length"),
    }
    return found.withColumns({name: F.coalesce(columns[name].cast("double"), F.lit(0.0)) for name in FEATURES})


def weak_labels(featured: DataFrame) -> DataFrame:
    """Adds label by rule: varied, no placeholder, and assigned, of known shape, told to be a credential, or random.

    A value of hexadecimal digits alone may be a digest, so it needs an assignment or a word before it.
    """
    f = {name: F.col(name) for name in FEATURES}
    free = (f["uuid"] == 0) & (f["in_path"] == 0) & (f["digest_told"] == 0) & (f["data"] == 0) & (f["uppers"] + f["lowers"] > 0)
    told = free & (f["told"] == 1) & (f["digits"] > 0) & (f["entropy"] >= 3.0) & (f["wordlike"] < 0.7)
    mixed = (f["uppers"] > 0) & (f["lowers"] > 0) & (f["others"] <= 0.2) & (f["entropy"] >= 3.7) & (f["transitions"] >= 0.4) & (f["wordlike"] < 0.5)
    one_case = (f["others"] == 0) & (f["entropy"] >= 3.3) & (f["transitions"] >= 0.3)
    random = free & f["length"].between(20, 512) & (f["hex"] == 0) & (f["digits"] * f["length"] >= 2) & (f["digits"] <= 0.6) & (mixed | one_case)
    shape = (f["shape"] == 1) & (f["wordlike"] < 0.7)
    secret = ((f["assigned"] == 1) | shape | told | random) & (f["entropy"] >= 2.5) & (f["placeholder"] == 0)
    return featured.withColumn("label", secret.cast("double"))


def train(labelled: DataFrame, seed: int = 7) -> PipelineModel | None:
    """A forest over ``FEATURES`` from labelled findings; None if they hold one class only."""
    if labelled.select("label").distinct().limit(2).count() < 2:
        return None
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_predicted",
        numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt",
    )
    return Pipeline(stages=[assembler, forest]).fit(labelled)


def judged(featured: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Adds probability (of being a secret); without a model the weak label."""
    if model is None:
        return weak_labels(featured).withColumnRenamed("label", "probability")
    scored = model.transform(featured)
    return scored.withColumn("probability", vector_to_array("_probability")[1]).drop("_features", "_probability", "_raw", "_predicted")


def scan(parts: DataFrame, keep: list[str], labelled: DataFrame | None = None) -> DataFrame:
    """The secrets in a stored ``marked`` table: _row, part, start, length, finding, probability."""
    found = materialize(candidates(parts, keep), "candidates")
    sample = found.withColumn("_h", F.xxhash64("finding", "before", "after")).orderBy("_h", "_row", "part").limit(FINDINGS).drop("_h")
    words = dictionary(sample)
    told = labelled is not None
    if not told:
        labelled = weak_labels(with_features(sample, words)).select("label", *FEATURES)
    model = train(materialize(labelled, "findings"))
    scored = judged(with_features(found, words), model)
    if model is not None and not told:
        scored = weak_labels(scored).withColumn("probability", F.greatest("probability", "label")).drop("label")
    return scored.where(F.col("probability") >= ACCEPT)


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """key, start (characters before it), length, finding and probability of every secret."""
    parts = materialize(marked(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text").drop("_text"), "marked")
    found = scan(parts, ["_key"], labelled)
    return found.select(F.col("_key").alias(key), F.col("start").cast("long"), F.col("length").cast("long"), "finding", "probability")


def redacted(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """All documents, secrets in their texts replaced by ``REDACTED`` (and n_chars adapted)."""
    held = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("_text"))
    parts = materialize(marked(held, "_text"), "marked")
    gone = scan(parts, []).groupBy("_row").agg(F.collect_set("part").alias("_gone"))
    joined = parts.join(materialize(gone, "gone"), "_row", "left")
    cleaned = F.array_join(F.transform("_parts", lambda s, i: F.when(F.array_contains("_gone", i), F.lit(REDACTED)).otherwise(s)), "")
    new = {text: cleaned}
    if n_chars in docs.columns:
        new[n_chars] = F.length(cleaned).cast(docs.schema[n_chars].dataType)
    own = {c: F.col("_doc").getField(c) for c in docs.columns}
    changed = joined.select(*[(F.when(F.col("_gone").isNull(), own[c]).otherwise(new[c]) if c in new else own[c]).alias(c) for c in docs.columns])
    return docs.where(~has_candidate(F.col(text))).unionByName(changed)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.sha2("finding", 256).alias("finding_sha256"), "probability")


QUERIES = {"op10_secrets": (op10_secrets, None)}
