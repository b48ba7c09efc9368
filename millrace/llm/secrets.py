"""Secret scans: candidates by pattern, and a random forest that throws out false positives. DataFrame functions only.

Candidates are found by one regular expression, each to its end, however long it is. Each gets features: its length, how often its characters
change class, how much of it dictionary words cover, the kinds and variety of its characters, whether the
path looks like a test or document, and whether neighbouring words speak of secrets or of digests and ids. A
random forest is trained on labelled findings (value, before, path, label), by default a bounded set
that :func:`labelled_findings` makes by rule. The trees become one SQL expression, so scanning is a projection
of the documents: no shuffle, no Python, nothing that grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fresh, read

#: What stands before an assigned value: a name with one of the words in it, whatever segments precede or follow, and the sign.
#: The name is consumed at once (possessive), so long names cost one pass; "author" or "tokenizer" don't hold a word.
NAME = r"(?<![A-Za-z0-9_.-])(?=[A-Za-z0-9_.-]*?(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth)(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z])))[A-Za-z0-9_.-]++[\"']?\s{0,3}[:=]\s{0,3}[\"']?+"
#: Public formats of keys and tokens, and the names that assignments of secrets use. Values have no upper
#: length: a value runs to its end, a private key to its END line or, without one, to the end of the text.
RULES = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36}\b",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe_key": r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "jwt": r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----(?s:.*?)(?:-----END [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----|\z)",
    "assignment": NAME + r"(?:(?!-----BEGIN )[^\s\"',;]){8,}+",
    "long_token": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?:(?!-----BEGIN )[A-Za-z0-9+/_-]){20,}+={0,2}(?![A-Za-z0-9+/_=-])",
}
SECRET_WORDS = "password|passwd|pwd|secret|token|key|auth|bearer|credential|login"
BENIGN_WORDS = "commit|sha|sha1|sha256|md5|hash|digest|checksum|etag|revision|uuid|guid|id|build|version|example|sample|placeholder|image|file|path"
DICTIONARY = "example|sample|placeholder|changeme|password|secret|token|test|dummy|default|your|here|insert|user|name|admin|data|file|path|image|index|config|server|client|service|request|response|value|string|number|object|class|function|method|module|package|version|release|update|create|delete|select|print|message|error|handler|controller|manager|factory|builder|account|email|address|phone|order|customer|product|item|list|array|table|column|row|header|content|document|the|and|for|with|from|that|this|not|none|null|true|false|xxxx|abcd|1234"
TEST_PATHS = r"(?i)test|spec|example|sample|doc|fixture|mock"
FEATURES = ["n", "changes", "covered", "digits", "upper", "variety", "path", "near_secret", "near_benign", "known", "hexonly", "dashes", "spread"]


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def features(value: Column, before: Column, path: Column, rule: Column) -> dict[str, Column]:
    """Feature columns of one candidate; nulls count as empty."""
    v = F.coalesce(value, F.lit(""))
    n = F.greatest(F.length(v), F.lit(1)).cast("double")
    kind = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]", "0"), "[A-Z]", "A"), "[aeiouy]", "e"), "[b-df-hj-np-tv-xz]", "c")
    runs = F.length(F.regexp_replace(kind, r"(.)\1+", "$1")).cast("double")
    low = F.lower(v)
    letters = F.split(low, "")
    return {
        "n": n,
        "changes": runs / n,
        "covered": 1 - F.length(F.regexp_replace(low, DICTIONARY, "")) / n,
        "digits": F.length(F.regexp_replace(v, "[^0-9]", "")) / n,
        "upper": F.length(F.regexp_replace(v, "[^A-Z]", "")) / n,
        "variety": F.size(F.array_distinct(letters)) / n,
        "path": _flag(F.coalesce(path, F.lit("")).rlike(TEST_PATHS)),
        "near_secret": _flag((rule == "assignment") | F.lower(before).rlike(rf"(?:{SECRET_WORDS})[\W_]*$")),
        "near_benign": _flag(F.lower(before).rlike(rf"\b(?:{BENIGN_WORDS})\W*$")),
        "known": _flag(~rule.isin("assignment", "long_token")),
        "hexonly": _flag(low.rlike("^[0-9a-f]+$")),
        "dashes": F.length(F.regexp_replace(v, "[^-/_.]", "")) / n,
        "spread": F.size(F.array_distinct(letters)).cast("double"),
    }


def labelled_findings(spark: SparkSession, n: int = 4000, seed: int = 7) -> DataFrame:
    """(value, before, path, rule, label): ``n`` findings made by rule from hashes, half of them secrets.

    A stand-in for reviewed findings; pass your own with the same columns for other corpora.
    """
    r = lambda k: F.sha2(F.concat_ws(":", F.lit(seed), F.lit(k), F.col("id")), 512)
    num = lambda k, m: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), F.lit(m))
    pick = lambda k, *xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), (num(k, len(xs)) + 1).cast("int"))
    b64 = lambda k, size: F.substring(F.regexp_replace(F.base64(F.unhex(r(k))), "[+/=]", "x"), 1, size)
    hexa = lambda k, size: F.substr(r(k), F.lit(1), F.lit(size) if isinstance(size, int) else size)
    word = lambda k: pick(k, "the", "value", "order", "config", "service", "manager", "index", "data", "customer", "handler", "request", "file")
    # random base64 of 86 to 3440 characters
    blob = lambda k: F.array_join(F.transform(F.sequence(F.lit(1), (num(k, 40) + 1).cast("int")), lambda i: F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat_ws(":", F.lit(seed), F.lit(k), F.col("id"), i), 512))), "[=\\r\\n]", "")), "")
    kind_of_key = pick(33, "RSA ", "EC ", "", "OPENSSH ")
    key_block = F.concat(F.lit("-----BEGIN "), kind_of_key, F.lit("PRIVATE KEY-----\n"), F.regexp_replace(blob(34), "(.{64})", "$1\n"), F.lit("\n-----END "), kind_of_key, F.lit("PRIVATE KEY-----"))
    noise = pick(20, "in the ", "and ", "of this ", "was ", "see ", "")
    def f(value: Column, before: Column, rule: Column | str) -> Column:
        rule = F.lit(rule) if isinstance(rule, str) else rule
        return F.struct(value.alias("value"), before.alias("before"), rule.alias("rule"))

    secret = pick(
        1,
        f(F.concat(F.lit("AKIA"), F.upper(F.translate(b64(2, 16), "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz"))), noise, "aws_access_key"),
        f(hexa(3, (F.lit(16) + num(4, 33)).cast("int")), F.concat(noise, pick(5, "password=", "passwd: ", "pwd = \"", "secret=")), "assignment"),
        f(hexa(6, 40), F.concat(noise, pick(7, "token = \"", "api_key=", "auth: ")), "assignment"),
        f(b64(8, 32), F.concat(noise, pick(9, "secret: ", "access_key=\"", "token=")), "assignment"),
        f(F.concat(F.lit("ghp_"), b64(10, 36)), noise, "github_token"),
        f(b64(11, 44), F.concat(noise, pick(12, "bearer ", "key ", "credential ")), "long_token"),
        f(key_block, noise, "private_key"),
        f(b64(35, 40), F.concat(noise, pick(36, "AWS_SECRET_ACCESS_KEY=", "DB_USER_PASSWORD=", "dbPassword = \"", "authTokenValue: ")), "assignment"),
        f(blob(37), F.concat(noise, pick(38, "token=", "secret: ", "api_key = \"", "APP_SESSION_TOKEN=")), "assignment"),
        f(F.concat(F.lit("eyJ"), blob(39), F.lit("."), blob(40), F.lit("."), b64(41, 43)), F.concat(noise, pick(42, "token=", "auth: ")), "assignment"),
        f(blob(43), F.concat(noise, pick(44, "bearer ", "key ", "credential ")), "long_token"),
    )
    uuid = F.concat_ws("-", hexa(13, 8), F.substring(r(13), 9, 4), F.substring(r(13), 13, 4), F.substring(r(13), 17, 4), F.substring(r(13), 21, 12))
    benign = pick(
        14,
        f(hexa(2, 40), F.concat(noise, pick(3, "commit ", "sha1: ", "digest ", "revision ", "etag ", "build ")), "long_token"),
        f(hexa(4, 64), F.concat(noise, pick(5, "sha256 ", "checksum: ", "hash ")), "long_token"),
        f(uuid, F.concat(noise, pick(6, "id ", "uuid: ", "guid=", "")), "long_token"),
        f(F.concat_ws("_", word(7), word(8), word(9), num(10, 100).cast("string")), F.concat(noise, pick(11, "file ", "path ", "", "token=")), pick(11, "long_token", "long_token", "long_token", "assignment")),
        f(pick(12, "changeme", "your_password_here", "xxxxxxxxxxxx", "example_token_1234", "placeholder", "<your-token>", "${PASSWORD}", "********"), pick(13, "password=", "token = \"", "secret: "), "assignment"),
        f(F.concat_ws("/", word(15), word(16), F.concat(word(17), num(18, 10_000).cast("string")), word(19)), noise, "long_token"),
        f(F.concat(word(15), word(16), word(17), num(18, 99).cast("string")), F.concat(noise, pick(19, "", "image ", "token=")), pick(19, "long_token", "long_token", "assignment")),
        f(F.repeat(num(15, 10).cast("string"), 24), noise, "long_token"),
        f(blob(45), F.concat(noise, pick(46, "data:image/png;base64,", "image ", "file ")), "long_token"),
    )
    # nothing in the texts themselves says which path they have, so paths vary over both kinds
    both = spark.range(n).select("id", F.when(num(0, 2) == 1, secret).otherwise(benign).alias("f"), (num(0, 2) == 1).cast("double").alias("label"))
    risky = F.when((F.col("label") == 0) & (num(21, 3) == 0), F.lit("tests/fixtures")).otherwise(pick(22, "src", "src0", "src7", "web"))
    return both.select("f.value", "f.before", risky.alias("path"), "f.rule", "label")


class Forest:
    """The trees of a trained forest as plain tuples, and their mean as a column."""

    def __init__(self, trees: list):
        self.trees = trees

    def score(self, of: dict[str, Column]) -> Column:
        def walk(t):
            return F.lit(t) if isinstance(t, float) else F.when(of[FEATURES[t[0]]] <= t[1], walk(t[2])).otherwise(walk(t[3]))

        total = walk(self.trees[0])
        for t in self.trees[1:]:
            total = total + walk(t)
        return total / len(self.trees)


def train(findings: DataFrame, trees: int = 15, depth: int = 5, seed: int = 7) -> Forest:
    """Fit the forest on labelled findings; their number is the caller's bound (4000 by default)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    fs = features(F.col("value"), F.col("before"), F.col("path"), F.col("rule"))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(findings.select("label", *[c.cast("double").alias(k) for k, c in fs.items()]))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=4).fit(rows)

    def walk(node):
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return float(stats[1] / sum(stats)) if sum(stats) else 0.0
        return (node.split().featureIndex(), float(node.split().threshold()), walk(node.leftChild()), walk(node.rightChild()))

    return Forest([walk(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode")) for t in model.trees])


def candidates(text: Column, path: Column, forest: Forest, context: int = 40) -> Column:
    """Array of structs (rule, value, score), one for each distinct candidate of a text, in order of appearance.

    Every place of a candidate is judged by the text in front of it; the candidate has its places' highest score.
    """
    every = "|".join(f"(?:{p})" for p in RULES.values())
    value_of = f"^{NAME}"
    raw = F.regexp_extract_all(text, F.lit(every), F.lit(0))

    def between(r: Column) -> Column:
        # most texts have no candidate, and are not gone through again
        return F.struct(r.alias("raw"), F.when(F.size(r) > 0, F.split(text, every, -1)).alias("between"))

    def places(f: Column) -> Column:
        # what stands before a place: the text since the place before it, and that place's own end
        lead = lambda i: F.concat(F.coalesce(F.right(F.get(f["raw"], i - 1), F.lit(context)), F.lit("")), F.right(F.get(f["between"], i), F.lit(context)))
        return F.transform(f["raw"], lambda x, i: F.struct(x.alias("raw"), F.right(lead(i), F.lit(context)).alias("lead")))

    def name(x: Column) -> Column:
        rule = F.lit("long_token")
        for k in reversed([k for k in RULES if k != "long_token"]):
            rule = F.when(x["raw"].rlike(f"^(?:{RULES[k]})" if k != "assignment" else value_of), F.lit(k)).otherwise(rule)
        return F.struct(x["raw"].alias("raw"), x["lead"].alias("lead"), rule.alias("rule"))

    def look(x: Column) -> Column:
        assigned = x["rule"] == "assignment"
        value = F.when(assigned, F.regexp_replace(x["raw"], value_of, "")).otherwise(x["raw"])
        lead = F.when(assigned, F.concat(x["lead"], F.regexp_extract(x["raw"], value_of, 0))).otherwise(x["lead"])
        return F.struct(x["rule"].alias("rule"), value.alias("value"), lead.alias("before"))

    def measure(x: Column) -> Column:
        fs = features(x["value"], x["before"], path, x["rule"])
        return F.struct(x["rule"].alias("rule"), x["value"].alias("value"), *[c.cast("double").alias(k) for k, c in fs.items()])

    def judge(x: Column) -> Column:
        return F.struct(x["rule"].alias("rule"), x["value"].alias("value"), forest.score({k: x[k] for k in FEATURES}).alias("score"))

    def once(all_: Column) -> Column:
        same = lambda x, y: (x["rule"] == y["rule"]) & (x["value"] == y["value"])
        distinct = F.array_distinct(F.transform(all_, lambda x: F.struct(x["rule"].alias("rule"), x["value"].alias("value"))))
        best = lambda x: F.array_max(F.transform(F.filter(all_, lambda y: same(x, y)), lambda y: y["score"]))
        return F.transform(distinct, lambda x: F.struct(x["rule"].alias("rule"), x["value"].alias("value"), best(x).alias("score")))

    # transform over one-element arrays names a value once, so it isn't computed for each use
    placed = F.flatten(F.transform(F.transform(F.array(raw), between), places))
    judged = F.transform(F.transform(F.transform(F.transform(placed, name), look), measure), judge)
    return F.flatten(F.transform(F.array(judged), once))


_FOREST: list = []


def default_forest(spark: SparkSession) -> Forest:
    if not _FOREST:
        _FOREST.append(train(labelled_findings(spark)))
    return _FOREST[0]


def scan(docs: DataFrame, forest: Forest | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate: id, finding (int, from 0), rule, value, score, is_secret (score > 0.5).

    Null and empty texts have no candidates; a null path counts as empty; rows with null or repeated ids keep
    their rows. A value that stands several times in a text is one candidate, judged at each of its places. Extra columns are ignored.
    """
    forest = forest or default_forest(docs.sparkSession)
    path = F.col(path_col) if path_col else F.lit("")
    c = docs.select(F.col(id_col).alias("id"), F.posexplode(candidates(F.col(text_col), path, forest)).alias("finding", "c"))
    return c.select("id", "finding", "c.rule", "c.value", "c.score", (F.col("c.score") > 0.5).alias("is_secret"))


def redact(docs: DataFrame, forest: Forest | None = None, text_col: str = "text", path_col: str | None = "source", mask: str = "[SECRET]") -> DataFrame:
    """docs with every confirmed secret in the text replaced by ``mask``; all other text and all columns stay.

    A secret is masked wherever it stands, whatever stands before it there, but not inside a longer word.
    """
    forest = forest or default_forest(docs.sparkSession)
    path = F.col(path_col) if path_col else F.lit("")
    found = F.filter(candidates(F.col(text_col), path, forest), lambda x: x["score"] > 0.5)
    name = fresh(docs, "found")[0]
    # the longest first: a value may be part of another
    longest = F.array_sort(name, lambda a, b: F.length(b["value"]) - F.length(a["value"]))
    quoted = lambda v: F.concat(F.lit(r"\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    left = lambda v: F.when(v.rlike("^[A-Za-z0-9]"), F.lit("(?<![A-Za-z0-9])")).otherwise("")
    right = lambda v: F.when(v.rlike("[A-Za-z0-9]$"), F.lit("(?![A-Za-z0-9])")).otherwise("")
    plain = mask.replace("\\", "\\\\").replace("$", "\\$")
    hidden = F.aggregate(longest, F.col(text_col), lambda acc, x: F.regexp_replace(acc, F.concat(left(x["value"]), quoted(x["value"]), right(x["value"])), F.lit(plain)))
    return docs.withColumn(name, found).withColumn(text_col, F.when(F.size(name) > 0, hidden).otherwise(F.col(text_col))).drop(name)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, finding, rule, value_sha256, length, score, is_secret for every candidate of every document."""
    f = scan(read(spark, sf_dir, "documents"))
    return f.select(
        F.col("id").alias("doc_id"), "finding", "rule", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), "score", "is_secret"
    )
