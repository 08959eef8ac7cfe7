"""Secret scan: candidates by pattern, false positives removed by a random forest. DataFrame functions and
Spark ML only (both run in the JVM).

Candidates are runs of at least ``min_length`` token characters, and shorter values assigned to a secret name. Features: length, character transitions, digit,
upper-case and distinct-character shares, dictionary coverage, path signs, and the neighbouring words before and after. The
forest is trained from labelled findings, a frame of (before, candidate, after, label). ``labelled_findings`` builds the
default set: up to ``TRAIN_ROWS`` rows (the documented bound) of secrets in assignments and headers and, by their own shape (prefixed or
mixed-case random), in prose, lists and URLs, and of look-alikes, also after secret words in prose: digests, ids, paths,
identifiers, long words and numbers, from a seeded rule. Hexadecimal strings are secrets only where a secret name is assigned or sent.

Nulls and odd rows: null or empty text has no candidates; a text may be of any length (its candidates are
extracted in place, one row each); equal candidates and repeated rows each give their own findings; an empty
table gives no rows; the caller chooses which columns go along, and those named like a column of the findings get an underscore at their end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import free_names, table, written

MIN_LENGTH = 16
THRESHOLD = 0.5
TRAIN_ROWS = 6000
ASSIGNED_LENGTH = 8
CHARS = "A-Za-z0-9_+/\\-"
MASK = "[SECRET]"

# Common words and word parts for dictionary coverage.
DICTIONARY = ("the", "and", "ing", "tion", "that", "for", "with", "this", "from", "have", "not", "are", "was", "ment",
              "able", "ness", "ung", "sch", "lich", "keit", "heit", "ein", "und", "der", "die", "das", "les", "des", "pour",
              "dans", "eau", "aux", "que", "los", "las", "ción", "para", "ando", "user", "name", "data", "file", "test",
              "value", "class", "index", "config", "service", "manager", "image", "public", "static", "string")
SECRET_WORDS = "token|secret|passw|pwd|api.?key|apikey|access.?key|private.?key|auth(?!ors?[^a-z])|credential|bearer|client.?key"
#: A name with a secret word in it and an assignment sign; bounded, so it can be looked for backwards.
ASSIGNED = f"(?i:{SECRET_WORDS})[A-Za-z0-9_\\-]{{0,16}}[\"']?[ \\t]{{0,2}}(?:=>|:=|[=:])[ \\t]{{0,2}}"
#: Provider prefixes by shape: one or two short parts before a long one with a digit, or a fixed start.
PREFIXED = "^([A-Za-z]{2,6}[_\\-]){1,2}(?=[A-Za-z0-9]*[0-9])(?=[a-z0-9]*[A-Z]|[A-Z0-9]*[a-z])[A-Za-z0-9_\\-]{12,}$|^A[KS]IA[0-9A-Z]{12,}$|^AIza[A-Za-z0-9_\\-]{16,}$"
OTHER_WORDS = "sha|md5|commit|digest|checksum|hash|uuid|guid|etag|integrity|revision|id\\b|href|src|path|import|file"
FEATURES = ("length", "transitions", "vowel_turns", "digits", "uppers", "distinct", "coverage", "path_signs", "is_hex",
            "secret_near", "secret_before", "key_assigned", "assigned", "quoted", "other_near", "marks", "name_follows",
            "prefixed", "mixed", "longest_lower")


def candidate_pattern(min_length: int) -> str:
    """Values of at least ``ASSIGNED_LENGTH`` characters assigned to a secret name, punctuation included, and runs of at least
    ``min_length`` token characters. '=' ends a run, except as padding."""
    short, stop = min(ASSIGNED_LENGTH, min_length), "\\s\"'&,;<>()\\[\\]{}="
    quoted = f"(?<=[\"'])(?<={ASSIGNED}[\"'])(?![A-Za-z]{{2,10}}://)[^\\s\"'<>]{{{short},}}+(?=[\"'])"
    bare = (f"(?<=[=:>][ \\t]{{0,2}})(?<={ASSIGNED})(?![A-Za-z]{{2,10}}://)[^{stop}]{{{short - 1},}}[^{stop}.:]"
            f"(?:==?(?![{CHARS}=\"']))?")
    return f"{quoted}|{bare}|(?<![{CHARS}])[{CHARS}]{{{min_length},}}+(?:==(?![{CHARS}=])|=(?![{CHARS}=\"']|[ \\t]+\\S))?"


def candidates(docs: DataFrame, keep: Sequence[str | Column], text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``keep`` columns, nth (place among the text's candidates), before (the 48 characters of text before it, earlier
    candidates included), candidate, after (up to 16 characters). Narrow: one pass, candidates only leave it."""
    pattern = candidate_pattern(min_length)
    hit = docs.filter(F.col(text).rlike(pattern))
    pieces = F.split(F.col(text), pattern)
    near = F.transform(pieces, lambda p: F.struct(F.right(p, F.lit(48)).alias("tail"), F.left(p, F.lit(16)).alias("head")))
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    df = hit.select(F.struct(*keep).alias("__row"), found.alias("__found"), near.alias("__near"))
    kept = df.schema["__row"].dataType.names
    named = [F.col("__row")[c].alias(free) for c, free in zip(kept, free_names(kept, ("nth", "before", "candidate", "after", "score", "is_secret", *FEATURES)))]
    last = lambda a, b: F.right(F.concat(a, b), F.lit(48))
    moved = lambda c, k: F.slice(F.concat(F.array_repeat(F.lit(""), k), F.col(c)), F.lit(1), F.size(c))
    # the text up to the end of each candidate, by doubling: one, two, four ... candidates with what is before each
    df = df.withColumn("__t1", F.zip_with("__found", F.slice("__near", F.lit(1), F.size("__found")), lambda c, p: last(p["tail"], c)))
    reach = 1
    while reach * min(ASSIGNED_LENGTH, min_length) < 48:
        df = df.withColumn(f"__t{2 * reach}", F.zip_with(moved(f"__t{reach}", reach), f"__t{reach}", last))
        reach *= 2
    df = df.withColumn("__before", F.zip_with(moved(f"__t{reach}", 1), F.slice("__near", F.lit(1), F.size("__found")),
                                              lambda t, p: last(t, p["tail"])))
    rows = F.zip_with(F.zip_with("__found", "__before", lambda c, t: F.struct(c.alias("candidate"), t.alias("before"))),
                      F.slice("__near", F.lit(2), F.size("__found")),
                      lambda c, p: F.struct(c["before"], c["candidate"], p["head"].alias("after")))
    return df.select("__row", F.posexplode(rows).alias("nth", "__one")).select(*named, "nth", "__one.*")


def with_features(found: DataFrame) -> DataFrame:
    """Adds the ``FEATURES`` as doubles."""
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    size = F.length(c)
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / size
    flag = lambda cond: cond.cast("double")
    edge = "(?<=[a-zA-Z])(?=[0-9])|(?<=[0-9])(?=[a-zA-Z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    turns = "(?i)(?<=[aeiouy])(?=[bcdfghjklmnpqrstvwxz])|(?<=[bcdfghjklmnpqrstvwxz])(?=[aeiouy])"
    uncovered = F.length(F.regexp_replace(F.lower(c), "|".join(DICTIONARY), ""))
    made = {
        "length": size, "transitions": share(edge), "vowel_turns": share(turns), "digits": share("[0-9]"),
        "uppers": share("[A-Z]"), "distinct": F.size(F.array_distinct(F.split(c, ""))) / size,
        "coverage": 1 - uncovered / size, "path_signs": F.regexp_count(c, F.lit("/")) + flag(before.rlike("[/.@]$")) + flag(after.rlike("^[/.@:]")),
        "is_hex": flag(c.rlike("^[0-9a-f]+$") | c.rlike("^[0-9A-F]+$")), "secret_near": flag(before.rlike(f"(?i){SECRET_WORDS}")),
        "secret_before": flag(before.rlike(f"(?i)({SECRET_WORDS})[^A-Za-z0-9]{{0,8}}$")), "key_assigned": flag(before.rlike(f"{ASSIGNED}[\"']?$")), "assigned": flag(before.rlike("[=:>]\\s*[\"']?$")),
        "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")), "other_near": flag(before.rlike(f"(?i)(^|[^a-z])({OTHER_WORDS})")),
        "prefixed": flag(c.rlike(PREFIXED)), "mixed": flag(c.rlike("[a-z]") & c.rlike("[A-Z]") & c.rlike("[0-9]")),
        "longest_lower": F.array_max(F.transform(F.split(c, "[^a-z]+"), lambda x: F.length(x))) / size,
        "marks": share(f"[^{CHARS}=]"), "name_follows": flag(after.rlike("^[\"']?[ \\t]{0,2}(=>|:=|[=:])")),
    }
    return found.select("*", *[made[name].cast("double").alias(name) for name in FEATURES])


def labelled_findings(spark: SparkSession, rows: int = TRAIN_ROWS, seed: int = 42) -> DataFrame:
    """(before, candidate, after, label): labelled findings from a seeded rule, one at most for each of ``rows`` rendered
    lines. ``candidates`` finds them in the lines, so training sees what a scan sees."""
    r = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "id")
    pick = lambda k, options: F.element_at(F.array(*map(F.lit, options)), (F.pmod(r(k), F.lit(len(options))) + 1).cast("int"))
    made = spark.range(0, rows, 1, 4).withColumn("hexes", F.sha2(F.concat(r(1).cast("string"), r(2).cast("string")), 256))
    made = made.withColumn("base", F.regexp_replace(F.base64(F.unhex("hexes")), "[=]+$", ""))
    hexes, base, word = F.col("hexes"), F.col("base"), F.col("word")
    cut = lambda value, k, low, high: F.substring(value, F.lit(1), (F.lit(low) + F.pmod(r(k), F.lit(high - low + 1))).cast("int"))
    case = lambda value, k: F.when(F.pmod(r(k), F.lit(4)) == 0, F.upper(value)).otherwise(value)
    clean = F.concat(F.lit("7"), F.translate(base, "+/", "pW"))
    prefixed = F.when(F.pmod(r(6), F.lit(5)) == 0, F.concat(F.lit("AKIA"), F.upper(cut(clean, 4, 16, 16)))).otherwise(
        F.concat(pick(6, ("ghp_", "ghp_", "sk-", "xoxb-", "AIza")), cut(clean, 4, 16, 36)))
    secret = F.when(F.pmod(r(3), F.lit(3)) == 0, case(cut(hexes, 4, 24, 64), 5)).when(
        F.pmod(r(3), F.lit(3)) == 1, cut(base, 4, 20, 43)).otherwise(
        prefixed)
    syllables = ("tion", "ing", "er", "sch", "ver", "eau", "ment", "que", "lich", "keit", "an", "re", "st", "ou", "la", "ci", "on", "the", "ein", "au")
    made = made.withColumn("word", F.concat(*[pick(10 + k, syllables) for k in range(7)]))
    snake = F.concat(pick(20, ("user", "data", "file", "config")), F.lit("_"), pick(21, ("name", "index", "value", "service")), F.lit("_"),
                     pick(22, ("manager", "string", "class", "image")))
    uuid = F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))
    path = F.concat(pick(23, ("usr", "var", "src", "img")), F.lit("/"), pick(24, ("local", "lib", "main", "static")), F.lit("/"), word)
    number = F.regexp_replace(cut(hexes, 25, 20, 30), "[a-f]", "7")
    marked = F.concat(cut(base, 40, 3, 7), pick(41, ("!", "@", "#", "$", "%", "*", "?", "~")), F.substring(hexes, 20, 3), pick(42, ("Zq", "x9", "7K", "pT")))
    name = F.upper(F.concat_ws("_", pick(43, ("stripe", "github", "service", "payment", "storage")), pick(44, ("secret", "access", "private", "webhook")),
                               pick(45, ("access_key", "secret_key", "auth_token", "password"))))
    camel = F.concat(pick(51, ("get", "set", "make", "Abstract", "Default")), pick(52, ("Access", "User", "Client", "Remote")),
                     pick(53, ("Token", "Secret", "Data", "Key")), pick(54, ("From", "For", "With", "Of")), pick(55, ("Store", "Request", "Factory", "Session")))
    kind = F.pmod(r(0), F.lit(17))
    bare = kind.isin(3, 4, 16)  # secrets that no secret word comes before
    positive = (kind < 5) | (kind == 16)
    value = F.when(bare, F.when(F.pmod(r(49), F.lit(2)) == 0, cut(base, 4, 20, 43)).otherwise(prefixed)).when(positive, F.when(F.pmod(r(46), F.lit(5)) == 0, marked).otherwise(secret)).when(kind == 12, name).when(
        kind == 13, F.when(F.pmod(r(47), F.lit(2)) == 0, snake).otherwise(word)).when(
        kind == 5, word).when(kind == 6, snake).when(kind == 7, uuid).when(kind == 8, path).when(
        kind == 9, number).when(kind == 14, camel).when(kind == 15, F.concat(pick(56, ("", "sha512-", "sha384-")), cut(base, 4, 32, 43))).when(kind == 10, case(cut(hexes, 26, 32, 64), 27)).otherwise(F.initcap(word))
    keys = pick(30, ("token", "secret", "password", "api_key", "apikey", "auth_token", "access_key", "client_key"))
    assign = pick(31, (" = \"", "=", ": ", ": '", " = '", "=\""))
    named = F.when(F.pmod(r(48), F.lit(3)) == 0, name).when(F.pmod(r(48), F.lit(3)) == 1, F.concat(F.lit("https://host.example/x?"), keys)).otherwise(case(keys, 32))
    inside = F.concat(F.substring(word, 1, 12), F.lit(" "), named, assign)
    header = F.concat(F.lit("Authorization: Bearer "))
    plain = F.concat(F.substring(word, 3, 14), pick(33, (" ", ", ", ". ", "\n", " (")))
    other = F.concat(F.substring(word, 2, 9), F.lit(" "), pick(34, ("commit ", "sha256: ", "md5=", "id: ", "etag \"", "href=\"/", "checksum ", "uuid ")))
    prose = F.concat(F.substring(word, 2, 9), pick(57, (" we leaked ", " see ", "\n- ", " use `", " https://host.example/a?sig=", " [\"", " (", " and then ", ", ")))
    spoken = F.concat(F.substring(word, 2, 9), pick(58, (" author ", " the token ", " key ", " a secret key of ", " auth ", " the password for ", " token id ", " (secret) ")))
    before = F.when(bare, prose).when((kind == 15), F.concat(F.substring(word, 2, 9), pick(59, (" integrity: ", " integrity=\"", " etag \"", " checksum ", " digest: ")))).when(
        (kind.between(5, 11) | (kind >= 14)) & (F.pmod(r(60), F.lit(3)) == 0), spoken).when((kind >= 14) & ~positive & (F.pmod(r(60), F.lit(3)) == 1), prose).when(positive, F.when((F.pmod(r(35), F.lit(8)) == 0) & (F.pmod(r(46), F.lit(5)) > 0), header).otherwise(inside)).when(kind == 13, inside).when(
        (kind == 10) | (kind == 7) | (kind == 8), other).when(F.pmod(r(36), F.lit(10)) == 0, F.concat(word, F.lit(" = "))).otherwise(plain)
    made = written(made.select("id", value.alias("value"), before.alias("before"), positive.cast("double").alias("label")), "secret-values")
    before = F.col("before")
    after = F.when(kind == 12, F.concat(assign, F.lit("x"))).when(before.endswith("\""), F.lit("\" ")).when(before.endswith("'"), F.lit("' ")).otherwise(pick(37, (" ", ", ", ".\n", "\n", "&&& ")))
    lines = made.select(F.concat(before, "value", after, F.lit("\nend")).alias("text"), "value", "label")
    return candidates(written(lines, "secret-lines"), ["value", "label"]).filter("candidate = value").select("before", "candidate", "after", "label")


def train_forest(findings: DataFrame, trees: int = 30, depth: int = 8, seed: int = 42) -> RandomForestClassificationModel:
    """A forest over the features of labelled findings (before, candidate, after, label)."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(findings))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows.select("features", "label"))


def score(found: DataFrame, forest: RandomForestClassificationModel, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score`` (probability of a secret) and ``is_secret`` to candidate rows."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(with_features(found))
    forest = forest.copy().setFeaturesCol("__features").setProbabilityCol("__probability").setRawPredictionCol("").setPredictionCol("")
    scored = forest.transform(rows)
    probability = vector_to_array("__probability")[1]
    return scored.select(*[F.col(f"`{c}`") for c in found.columns], probability.alias("score"), (probability >= threshold).alias("is_secret"))


def redact(docs: DataFrame, forest: RandomForestClassificationModel, text: str = "text", mask: str = MASK,
           min_length: int = MIN_LENGTH, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every accepted secret replaced by ``mask``; all other rows and columns unchanged.

    Verdicts depend on the text alone, so they are kept by text (128 bits of hash): copies are one row of the verdict table.
    """
    one, two = F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text))
    found = candidates(docs, [one.alias("k1"), two.alias("k2")], text, min_length)
    found = found.groupBy("k1", "k2", "nth").agg(F.first("before").alias("before"), F.first("candidate").alias("candidate"), F.first("after").alias("after"))
    hits = score(found, forest, threshold).filter("is_secret").groupBy("k1", "k2").agg(F.collect_set("nth").alias("__hits"))
    hits = written(hits, "secrets").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "__hits")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    joined = docs.select(*kept, one.alias("__one"), two.alias("__two")).join(
        hits, (F.col("__one") == F.col("__k1")) & (F.col("__two") == F.col("__k2")), "left")
    pattern = candidate_pattern(min_length)
    shown = F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)),
                        lambda c, i: F.when(F.array_contains("__hits", i), F.lit(mask)).otherwise(c))
    clean = F.array_join(F.flatten(F.zip_with(F.split(F.col(text), pattern), shown, lambda p, c: F.array(p, F.coalesce(c, F.lit(""))))), "")
    out = F.when(F.col("__hits").isNull(), F.col(text)).otherwise(clean)
    return joined.select(*[out.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op4_secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with its score and verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = candidates(docs, ["doc_id"])
    return score(found, train_forest(labelled_findings(spark))).select(
        "doc_id", "nth", "candidate", F.length("candidate").alias("length"), "score", "is_secret")
