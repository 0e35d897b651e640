"""Secret scans with a random forest against false positives, in DataFrame functions only.

A pattern proposes candidates; the forest tells secrets from look-alikes by the candidate's length,
its character classes and the transitions between them, how much of it dictionary words cover, the
path of the document, and the neighbouring words. The forest is trained on labelled findings by
MLlib and then written out as nested conditions, so that scoring is one expression per row: no
candidate leaves its row, whatever ids, nulls or repeated rows a table has.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Candidates: 16 or more characters of keys and hashes in a row, a digit among them wherever it
#: stands, and the padding after them; in NAME=value the name is no part of the candidate.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
#: Characters of the text on either side that count as neighbourhood.
CONTEXT = 48
MASK = "[SECRET]"
#: Dictionary for coverage, words that name secrets, and words that name harmless look-alikes.
DICTIONARY = ("the", "and", "that", "with", "for", "this", "from", "tion", "ing", "ent", "name", "value", "file", "user", "page", "index", "image", "data", "test", "example", "sample", "key", "your", "here", "time", "date", "version", "number", "list", "item", "der", "die", "und", "que", "les", "los", "con", "para", "pour", "http", "html", "www")
NAMES = r"(?i)(token|secret|passw|pwd|api.?key|apikey|access.?key|auth|bearer|credential|private.?key|client.?id)"
HARMLESS = r"(?i)(commit|sha-?1|sha-?256|md5|digest|checksum|revision|uuid|guid|isbn|etag|build|example|placeholder|sample|card|phone|order|hash|blob|tree)"
TEST_PATH = r"(?i)(test|example|sample|fixture|mock|docs?/|readme)"


def _features(text: Column, left: Column, right: Column, path: Column) -> dict[str, Column]:
    """What the forest sees of a candidate; all numbers, none null."""
    n = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    share = lambda pattern: 1 - F.char_length(F.regexp_replace(text, pattern, "")) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[a-z]+", "\u0001"), "[A-Z]+", "\u0002"), "[0-9]+", "\u0003")
    flag = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    near = F.concat(left, F.lit(" "), right)
    return {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "transitions": (F.char_length(F.regexp_replace(classes, "[^\u0001\u0002\u0003]+", "\u0004")) - 1) / n,
        "hex": flag(F.regexp_like(text, F.lit("^[0-9a-f]+$")) | F.regexp_like(text, F.lit("^[0-9A-F]+$"))),
        "all_digits": flag(F.regexp_like(text, F.lit("^[0-9-]+$"))),
        "distinct": F.size(F.array_distinct(F.split(text, ""))) / n,
        "dictionary": 1 - F.char_length(F.regexp_replace(F.lower(text), "|".join(DICTIONARY), "")) / n,
        "test_path": flag(F.regexp_like(F.coalesce(path, F.lit("")), F.lit(TEST_PATH))),
        "named": flag(F.regexp_like(left, F.lit(NAMES + r"[^\n]{0,16}$"))),
        "assigned": flag(F.regexp_like(left, F.lit(r"""[=:]\s*["']?$"""))),
        "quoted": flag(F.regexp_like(left, F.lit("[\"']$")) & F.regexp_like(right, F.lit("^[\"']"))),
        "harmless": flag(F.regexp_like(near, F.lit(HARMLESS))),
    }


def labelled_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """A labelled set of findings (candidate, left, right, path, label) made by rule, the same each time.

    Half are keys of the usual forms in the places where keys leak, among prose too; half are
    look-alikes: digests, card and phone numbers, identifiers, slugs, placeholders, and keys of test
    files. A tenth of either kind stands in the other kind's surroundings or in none.
    """
    i = F.col("id")
    h = F.sha2(F.concat(F.lit("finding"), i.cast("string")), 512)
    mixed = F.translate(F.base64(F.unhex(F.substring(h, 1, 96))), "+/=", "xYz")
    pick = lambda options, at: F.element_at(F.array(*(o if isinstance(o, Column) else F.lit(o) for o in options)), (F.conv(F.substring(h, at, 4), 16, 10).cast("int") % len(options) + 1))
    words = ["the", "release", "thereon", "neben", "avec", "entre", "page", "of", "in", "was"]
    prose = F.concat_ws(" ", pick(words, 97), pick(words, 101), pick(words, 105))
    secret = pick([
        F.substring(h, 1, 40), F.substring(h, 1, 32), F.substring(h, 1, 64), F.substring(mixed, 1, 40), F.substring(mixed, 1, 24),
        F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16))), F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)),
        F.concat(F.lit("sk_live_"), F.substring(mixed, 1, 24)),
    ], 65)
    digits = F.rpad(F.conv(F.substring(h, 1, 12), 16, 10), 16, "7")
    other = pick([
        F.substring(h, 1, 40), F.substring(h, 1, 32), digits, digits, F.concat(F.lit("2024"), F.substring(digits, 1, 14)),
        F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 12)),
        F.concat_ws("-", pick(words, 69), pick(words, 73), F.lit("example"), pick(words, 77), F.substring(digits, 1, 2)),
        F.concat_ws("/", F.lit("images"), pick(words, 69), pick(words, 73), F.concat(F.lit("page"), F.substring(digits, 1, 3))),
        F.lit("your_api_key_here_123"), F.lit("xxxxxxxxxxxxxxxx0000"), F.lit("00000000000000000000"),
        F.concat(F.lit("thereontion"), F.substring(digits, 1, 2), F.lit("ingenttheand")),
    ], 65)
    leak = pick(['token = "', "token=", 'api_key: "', "password = '", "SECRET_KEY=", "Authorization: Bearer ", "aws_access_key_id = ", 'client_secret: "'], 81)
    calm = pick(["commit ", "sha1 ", "checksum: ", "order ", "card ", "revision=", "", "", "uuid: ", "see ", "/"], 81)
    is_secret, odd = i % 2 == 0, F.conv(F.substring(h, 113, 2), 16, 10).cast("int") < 12
    before = F.when(is_secret & odd, F.lit("key ")).when(is_secret, leak).when(odd & (F.substring(h, 115, 1) < "8"), F.lit("id = ")).otherwise(calm)
    quote = F.when(F.regexp_like(before, F.lit("[\"']$")), F.substring(before, -1, 1)).otherwise(F.lit(""))
    test_key = ~is_secret & (F.substring(h, 117, 1) < "3")
    return spark.range(n).select(
        F.when(is_secret | test_key, secret).otherwise(other).alias("candidate"),
        F.concat(prose, F.lit(" "), F.when(test_key, leak).otherwise(before)).alias("left"),
        F.concat(F.when(test_key, F.lit("")).otherwise(quote), F.lit(" "), prose).alias("right"),
        F.when(test_key, F.lit("tests/fixtures/keys")).otherwise(pick(["src1", "src/app", "web", "src17", "config/prod"], 89)).alias("path"),
        is_secret.cast("int").alias("label"),
    )


def train(findings: DataFrame, trees: int = 24, depth: int = 7, seed: int = 7) -> list[str]:
    """The trees of a forest fitted to labelled findings, as text; a findings set is a bounded table."""
    named = _features(F.col("candidate"), F.col("left"), F.col("right"), F.col("path"))
    rows = findings.where(F.col("candidate").isNotNull() & F.col("label").isNotNull()).fillna("", ["left", "right", "path"])
    ready = VectorAssembler(inputCols=list(named), outputCol="seen").transform(
        rows.select(F.col("label").cast("double").alias("label"), *(c.cast("double").alias(k) for k, c in named.items()))
    )
    forest = RandomForestClassifier(featuresCol="seen", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(ready)
    return [t.toDebugString for t in forest.trees]


def _tree(lines: list[str], seen: list[Column]) -> Column:
    """A tree's indented text as nested conditions; consumes its lines."""
    line = lines.pop(0).strip()
    if line.startswith("Predict"):
        return F.lit(float(line.split(":")[1]))
    found = re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", line)
    if not found:
        raise ValueError(f"unknown line in a tree: {line}")
    yes = _tree(lines, seen)
    lines.pop(0)  # the matching Else
    return F.when(seen[int(found[1])] <= float(found[2]), yes).otherwise(_tree(lines, seen))


def _score(trees: list[str], seen: list[Column]) -> Column:
    """Share of the trees that vote for a secret."""
    votes = [_tree([x for x in t.split("\n")[1:] if x.strip()], seen) for t in trees]
    return reduce(lambda a, b: a + b, votes) / len(votes)


def findings(df: DataFrame, trees: list[str], text_col: str = "text", path_col: str = "source", threshold: float = 0.5, name: str = "findings") -> DataFrame:
    """``df`` with _secret_pieces (text between candidates) and findings: array of start, end, candidate, score, is_secret.

    ``start`` (from 0) and ``end`` count code points of the whole text. Null and empty texts have no
    findings, null paths are ''; all rows and columns stay, and the new ones, of which ``name`` names
    the second, replace columns of their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = list(_features(F.lit(""), F.lit(""), F.lit(""), F.lit("")))
    some = F.size("_secret_found") > 0
    length = lambda c: F.char_length(c)
    # Offsets: what stands before candidate k are k pieces and k - 1 candidates.
    ends = F.aggregate(
        F.zip_with(F.slice("_secret_pieces", F.lit(1), F.size("_secret_found")), F.col("_secret_found"), lambda p, c: F.struct(length(p).alias("p"), length(c).alias("c"))),
        F.array().cast("array<bigint>"),
        lambda acc, x: F.concat(acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x["p"] + x["c"]).cast("bigint"))),
    )
    # CONTEXT characters of the text itself: three candidates of 16 or more lie beside three pieces.
    part = lambda name, k, here: F.when(here, F.element_at(name, F.greatest(k, F.lit(1)))).otherwise("")
    before = lambda k: F.concat(*(x for j in (2, 1, 0) for x in (part("_secret_found", k - j - 1, k > j + 1), F.substring(part("_secret_pieces", k - j, k > j), -CONTEXT, CONTEXT))))
    after = lambda k: F.concat(*(x for j in (1, 2, 3) for x in (F.substring(part("_secret_pieces", k + j, k + j <= F.size("_secret_pieces")), 1, CONTEXT), part("_secret_found", k + j, k + j <= F.size("_secret_found")))))
    at = lambda k: {
        "candidate": F.element_at("_secret_found", k),
        "left": F.substring(before(k), -CONTEXT, CONTEXT),
        "right": F.substring(after(k), 1, CONTEXT),
    }

    def described(k: Column) -> Column:
        own = at(k)
        seen = _features(own["candidate"], own["left"], own["right"], F.col(path_col).cast("string"))
        end = F.element_at("_secret_ends", k)
        return F.struct(
            (end - length(own["candidate"])).alias("start"), end.alias("end"), own["candidate"].alias("candidate"),
            F.array(*(seen[n].cast("double") for n in names)).alias("seen"),
        )

    def judged(x: Column) -> Column:
        score = _score(trees, [F.element_at(x["seen"], i + 1) for i in range(len(names))])
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["candidate"].alias("candidate"), score.alias("score"))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,candidate:string,score:double>>")
    return (
        df.withColumn("_secret_found", F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
        .withColumn("_secret_pieces", F.when(some, F.split(text, CANDIDATE, -1)).otherwise(F.array(text)))
        .withColumn("_secret_ends", F.when(some, ends))
        .withColumn("_secret_described", F.when(some, F.transform(F.sequence(F.lit(1), F.greatest(F.size("_secret_found"), F.lit(1))), described)))
        .withColumn(name, F.coalesce(F.when(some, F.transform("_secret_described", judged)), empty))
        .withColumn(name, F.transform(name, lambda x: x.withField("is_secret", x["score"] > threshold)))
        .drop("_secret_found", "_secret_ends", "_secret_described")
    )


def scan(df: DataFrame, trees: list[str], id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """One row per finding: id, start, end, candidate, score, is_secret; see ``findings``."""
    found = findings(df.select(id_col, text_col, path_col), trees, text_col, path_col, threshold)
    return found.select(id_col, F.explode("findings").alias("_f")).select(id_col, "_f.*")


def redact(df: DataFrame, trees: list[str], text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """``df`` with every secret in the text replaced by a mask; texts without one stay as they are, null too."""
    own = "_secret_list"
    found = findings(df, trees, text_col, path_col, threshold, own)
    # Texts with one piece more than findings: piece, finding, piece, finding, ..., piece.
    said = lambda i: F.element_at(own, F.greatest(i, F.lit(1)))
    shown = lambda i: F.when(said(i)["is_secret"], F.lit(MASK)).otherwise(said(i)["candidate"])
    masked = F.array_join(F.transform("_secret_pieces", lambda p, i: F.when(i == 0, p).otherwise(F.concat(shown(i), p))), "")
    any_secret = F.exists(own, lambda x: x["is_secret"])
    return found.withColumn(text_col, F.when(any_secret, masked).otherwise(F.col(text_col))).select(*df.columns)
