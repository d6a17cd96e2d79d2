"""Secret scans: candidate strings, judged by a random forest compiled to DataFrame expressions.

A candidate is a run of at least `least` key characters with a letter and a digit. The forest reads its length, its
character mix and transitions, how much of it dictionary words cover, the path, and the words around it. It is
trained by pyspark.ml on labelled findings; its trees then become nested CASE expressions, so that the scan is one
projection without Python.

Defined cases: null and empty texts have no candidates; a text may have any number, each with its place (code points
before it); repeated rows give repeated findings; a null path counts as none; labelled findings need both labels,
else every candidate is reported with score 1 (nothing is removed without evidence); strings of fewer than `least`
characters are no candidates, and a dotted one (a signed token) is as many as its parts; a text of any length is
searched whole, with 40 and 16 characters beside each candidate read by the forest; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}+={0,2}"

#: Words and word parts that random strings seldom hold.
DICTIONARY = (
    "example", "sample", "test", "dummy", "changeme", "password", "secret", "placeholder", "your", "foo", "bar", "lorem", "ipsum", "version", "image",
    "http", "www", "com", "html", "index", "page", "user", "name", "file", "data", "node", "build", "release", "tion", "ing", "ment", "the", "and",
    "for", "with", "that", "ent", "ation", "est", "der", "die", "und", "les", "que", "ció", "xxx", "123456", "abcdef", "000000",
)
FEATURES = ("length", "digits", "upper", "hex", "turns", "distinct", "covered", "separators", "prefix", "key_word", "hash_word", "assigned", "quoted", "path_doubt", "path_config")


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def features(candidate: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """What the forest reads, as numbers."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    low, path = F.lower(candidate), F.lower(F.coalesce(path, F.lit("")))
    bare = F.regexp_replace(low, "|".join(DICTIONARY), "")
    return {
        "length": F.length(candidate).cast("double"),
        "digits": _share(candidate, "[0-9]"),
        "upper": _share(candidate, "[A-Z]"),
        "hex": flag(candidate.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "turns": _share(candidate, "(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(candidate, ""))) / F.greatest(F.length(candidate), F.lit(1)),
        "covered": 1 - F.length(bare) / F.greatest(F.length(candidate), F.lit(1)),
        "separators": _share(candidate, "[/_=+\\-]"),
        "prefix": flag(candidate.rlike("^(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|sk-|AIza|glpat-)")),
        "key_word": flag(F.lower(before).rlike(r"(?:token|secret|passw(?:or)?d|passwd|api[_-]?key|apikey|auth\w*|credential\w*|bearer|access[_-]?key)\W{0,6}$")),
        "hash_word": flag(F.lower(before).rlike(r"(?:sha\d*|md5|commit|rev\w*|hash|checksum|digest|etag|uuid|guid|build|id)\W{0,6}$")),
        "assigned": flag(before.rlike(r"[:=]\s*[\"']?$")),
        "quoted": flag(before.rlike(r"[\"']$") & after.rlike(r"^[\"']")),
        "path_doubt": flag(path.rlike(r"test|example|sample|fixture|docs?/|\.md$|\.lock$|mock")),
        "path_config": flag(path.rlike(r"\.env|config|settings|\.ya?ml$|\.ini$|\.properties$")),
    }


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", least: int = 16) -> DataFrame:
    """(id, path, start, candidate, before, after): start counts the code points before the candidate;
    before and after are the 40 and 16 code points of the text beside it."""
    pattern = CANDIDATE.replace("16", str(least))
    text = F.col(text_col)
    rows = docs.filter(text.rlike(pattern)).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    zipped = F.arrays_zip(F.col("found").alias("candidate"), F.slice("between", 1, F.size("found")).alias("pre"))
    pieces = F.concat(F.flatten(F.transform(zipped, lambda z: F.array(z["pre"], z["candidate"]))), F.slice("between", -1, 1))
    rows = rows.select("row", "id", "path", "found", "between", pieces.alias("pieces"))
    # The 40 code points before a candidate and the 16 after it, earlier and later candidates included: each of these
    # has at least `least`, so a few pieces of the text are enough.
    n_before, n_after = 2 * math.ceil(40 / least), 2 * math.ceil(16 / least)

    def item(z: Column, i: Column) -> Column:
        first = F.greatest(2 * i + 1 - n_before, F.lit(1))
        before = F.array_join(F.slice("pieces", first, 2 * i + 2 - first), "")
        after = F.array_join(F.slice("pieces", 2 * i + 3, F.lit(n_after + 1)), "")
        return F.struct(z["candidate"].alias("candidate"), F.right(before, F.lit(40)).alias("before"), F.left(after, F.lit(16)).alias("after"), F.length(z["pre"]).alias("gap"), F.length(z["candidate"]).alias("size"))

    items = F.transform(zipped, item)
    out = rows.select("row", "id", "path", F.posexplode(items).alias("place", "c")).select("row", "id", "path", "place", "c.*")
    so_far = Window.partitionBy("row").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("start", (F.sum(F.col("gap") + F.col("size")).over(so_far) - F.col("size")).cast("long"))
    return out.filter(F.col("candidate").rlike("[0-9]") & F.col("candidate").rlike("[A-Za-z]")).select("id", "path", "start", "candidate", "before", "after")


def labelled_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """(candidate, before, after, path, label): generated findings of fourteen kinds, every other one secrets. Four kinds
    are hard negatives in the very dress of secrets: placeholders of dictionary words behind `token = "`, digests and
    tags of as many hexadecimal digits, and picture data. Row n is made from SHA-256 of n alone."""
    n = F.col("id")
    h, g = F.sha2(F.concat(F.lit("a"), n.cast("string")).cast("binary"), 256), F.sha2(F.concat(F.lit("b"), n.cast("string")).cast("binary"), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(F.concat(h, g))), "[+/=]", "A")
    kind = F.element_at(F.array(*[F.lit(k) for k in (0, 5, 1, 6, 2, 7, 3, 8, 4, 12, 10, 13, 11, 14)]), (n % 14 + 1).cast("int"))
    word = F.element_at(F.split(F.lit(" ".join(w for w in DICTIONARY if w.isalpha() and len(w) > 3)), " "), (F.floor(n / 14) % 20 + 1).cast("int"))
    candidate = (
        F.when(kind == 0, F.substring(h, 1, 40)).when(kind == 1, F.concat(F.lit("AKIA"), F.upper(F.substring(b64, 1, 16)))).when(kind == 2, F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)))
        .when(kind == 3, F.substring(b64, 1, 32)).when(kind == 4, F.upper(F.substring(h, 1, 40)))
        .when(kind == 5, F.substring(h, 1, 40)).when(kind == 6, F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)))
        .when(kind == 7, F.concat(word, F.lit("_example_"), word, F.substring(F.regexp_replace(h, "[a-f]", ""), 1, 3))).when(kind == 8, F.concat(F.lit("images/"), word, F.lit("/page-"), F.substring(F.regexp_replace(h, "[a-f]", ""), 1, 5), F.lit("/index")))
        .when(kind == 10, F.concat(F.lit("eyJ"), F.substring(b64, 1, 33))).when(kind == 11, F.concat(h, F.substring(g, 1, 8)))
        .when(kind == 12, F.concat(F.lit("your_"), word, F.lit("_secret_here_"), F.substring(F.regexp_replace(h, "[a-f]", ""), 1, 2)))
        .when(kind == 13, h).when(kind == 14, F.concat(F.lit("iVBORw0KGgo"), F.substring(b64, 1, 40)))
        .otherwise(None)
    )
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.floor(n / 14) % len(xs) + 1).cast("int"))
    secret = (kind < 5) | kind.isin(10, 11)
    before = F.when((kind < 5) | kind.isin(11, 12), pick('token = "', 'TOKEN = "', "api_key: ", 'secret = "', "password=", 'auth_token: "', 'Bearer ')).when(kind == 5, pick("commit ", "sha1: ", "digest = ", 'etag: "', "checksum=")).when(kind == 6, pick("uuid ", "id: ", 'guid = "', "see ")).when(kind == 10, pick("Bearer ", 'token: "', "Authorization: Bearer ")).when(kind == 13, pick('sha256 = "', "digest: ", 'etag: "', "integrity=")).when(kind == 14, pick("data:image/png;base64,", 'src="data:image/png;base64,')).otherwise(pick("see ", "in ", "the ", 'href="', ", "))
    after = F.when(before.rlike('"$'), F.lit('" ')).otherwise(" ")
    path = F.when(secret | (kind == 12), pick("app/config.yml", "src/main.py", "src3", ".env", "web")).when(kind == 7, pick("tests/test_api.py", "docs/guide.md", "examples/run.py", "src7")).otherwise(pick("src/main.py", "package.lock", "src3", "web", "README.md"))
    return spark.range(rows).select(candidate.alias("candidate"), before.alias("before"), after.alias("after"), path.alias("path"), secret.cast("int").alias("label"))


def fit_forest(findings: DataFrame, trees: int = 15, depth: int = 5, seed: int = 5):
    """A forest over FEATURES, or None without both labels."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    known = findings.filter(F.col("label").isin(0, 1))
    if known.select("label").distinct().count() < 2:
        return None
    x = features(F.col("candidate"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), F.col("path"))
    known = known.select(F.col("label").cast("double").alias("label"), *[c.alias(k) for k, c in x.items()])
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(known)
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(data)


def compiled(forest) -> Column:
    """The forest's mean leaf probability of label 1 as one expression over the columns FEATURES."""

    def node(n) -> Column:
        if n.numDescendants() == 0:
            stats = list(n.impurityStats().stats())
            return F.lit(float(stats[1] / max(1e-9, sum(stats))))
        split = n.split()
        return F.when(F.col(FEATURES[split.featureIndex()]) <= float(split.threshold()), node(n.leftChild())).otherwise(node(n.rightChild()))

    trees = [node(t._java_obj.rootNode()) for t in forest.trees]
    return reduce(lambda a, b: a + b, trees) / float(len(trees))


def scan_secrets(docs: DataFrame, forest, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", cut: float = 0.5) -> DataFrame:
    """(id, path, start, length, candidate, score, secret) of every candidate; secret: score >= cut."""
    c = candidates(docs, id_col, text_col, path_col)
    x = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    scored = c.select("id", "path", "start", "candidate", *[v.alias(k) for k, v in x.items()])
    score = compiled(forest) if forest is not None else F.lit(1.0)
    return scored.withColumn("score", score).select("id", "path", "start", F.col("length").cast("long").alias("length"), "candidate", "score", (F.col("score") >= cut).alias("secret"))
