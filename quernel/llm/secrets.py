"""Secret scans with a random forest against false positives (operator 2). DataFrame functions only.

Candidates are long unbroken strings, and shorter values assigned to a name such as ``token`` or ``password``. One
pass of an anchored pattern cuts a text into (gap, candidate) pairs, so that a candidate's neighbours and its place
are at hand without searching again. Each candidate gets features of its length, character transitions, dictionary
coverage, its document's path, and neighbouring words; a forest votes on them. The forest is a few literal arrays
walked by ``aggregate``: scanning is a projection of the table, without a join, an exchange or Python on executors.

The forest is trained from labelled findings (value, path, before, after, label). ``example_findings`` makes such a
set with Spark functions: keys and tokens of common shapes against identifiers, paths, hashes named as such,
placeholders and numbers. ``train`` takes ``MOST_FINDINGS`` of its rows at most, by a hash of the row.

Edge cases: a null or empty text has no candidates; a null path is an empty path; null ids are kept; repeated rows
give repeated findings; extra columns are kept by ``redact`` and left out of the findings; an empty table gives no
rows. Places count code points from 0.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows that a forest is trained on at most.
MOST_FINDINGS = 20_000
EXAMPLES = 4_000
TREES, DEPTH, LEAF = 25, 7, 4
THRESHOLD = 0.5
MASK = "<secret>"
NEAR = 48

_RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}+"
_NAMED = r"(?<=[=:\x22'\x20\t])(?<=(?i:secret|token|passwd|password|pwd|api_?key)[\x22']?\s{0,3}[:=]\s{0,3}[\x22']?)[^\s\x22'<>]{8,}+"
#: A gap, then a candidate. \G keeps a search from starting anew at every place of a text's tail.
PATTERN = rf"\G(?s)(.*?)({_RUN}|{_NAMED})"
_PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur"
_WORDS = "password|passwd|secret|token|example|sample|account|address|service|request|response|config|version|default|string|number|object|value|field|table|column|index|query|select|update|delete|create|insert|master|server|client|local|remote|public|private|static|final|class|function|return|import|export|module|package|library|test|mock|dummy|change|your|here|this|that|with|from|user|name|data|file|path|type|time|date|code|text|line|page|home|image|style|script|http|https|html|json|main|node|list|item|group|level|state|error|event|admin|model|image|build|debug|release|check|valid|header|content|length|width|height|color|background|margin|padding|button|label|title|description|information|message|number|system|process|thread|memory|cache|store|stream|buffer|input|output|print|read|write|open|close|start|stop|begin|end"
FEATURES = ("length", "digits", "upper", "lower", "other", "runs", "pairs", "dictionary", "distinct", "entropy", "repeat", "hex", "decimal", "prefix", "quoted", "assigned", "named", "hashed", "placeholder", "path")


def _share(rest: Column, value: Column) -> Column:
    return (F.length(value) - F.length(rest)) / F.length(value)


def features(value: Column, path: Column, before: Column, after: Column) -> Column:
    """An array<double>, in the order of FEATURES."""
    low = F.lower(value)
    n = F.length(value).cast("double")
    kinds = F.regexp_replace(value, "[0-9]+|[a-z]+|[A-Z]+|[^0-9A-Za-z]+", "x")
    chars = F.split(value, "")
    counts = F.transform(F.array_distinct(chars), lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / n)
    entropy = F.aggregate(counts, F.lit(0.0), lambda s, p: F.when(p > 0, s - p * F.log2(p)).otherwise(s))
    flag = lambda c, pattern: c.rlike(pattern).cast("double")
    found = [
        n,
        _share(F.regexp_replace(value, "[0-9]", ""), value),
        _share(F.regexp_replace(value, "[A-Z]", ""), value),
        _share(F.regexp_replace(value, "[a-z]", ""), value),
        _share(F.regexp_replace(value, "[^0-9A-Za-z]", ""), value),
        F.length(kinds) / n,
        F.regexp_count(low, F.lit(f"(?=(?:{_PAIRS}))")) / n,
        _share(F.regexp_replace(low, f"(?:{_WORDS})", ""), value),
        F.size(F.array_distinct(chars)) / n,
        entropy,
        flag(low, r"(.)\1{4,}|(?:0123|1234|abcd|xyz|qwer)"),
        flag(value, r"^(?:[0-9a-f]+|[0-9A-F]+)$"),
        flag(value, r"^[0-9]+$"),
        flag(value, r"^(?:AKIA|ASIA|gh[pousr]_|glpat-|sk[-_]|pk_live|xox[abpr]-|AIza|eyJ|SG\.)"),
        (flag(before, r"[\x22'`]$") + flag(after, r"^[\x22'`]")) / 2,
        flag(before, r"[:=]\s*[\x22'`]?$"),
        flag(before, r"(?i)(?:secret|token|passw|pwd|credential|api.?key|access.?key|auth|private.?key)\W{0,6}(?:\w+\W{1,4})?$"),
        flag(before, r"(?i)(?:sha\d*|md5|commit|checksum|digest|integrity|uuid|guid|revision|hash|etag|build)\W{0,6}(?:\w+\W{1,4})?$"),
        flag(F.concat(before, low), r"(?i)example|placeholder|your[_-]|changeme|dummy|redacted|xxxx|insert[_-]"),
        flag(path, r"(?i)(?:^|[/_.-])(?:tests?|specs?|examples?|samples?|fixtures?|mocks?|docs?|lock|vendor|node_modules)(?:$|[/_.-])"),
    ]
    return F.array(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in found])


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays; a leaf has no left child."""

    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    value: tuple[float, ...]
    roots: tuple[int, ...]

    def _literal(self, name: str, kind: str) -> Column:
        return F.expr("array(" + ", ".join(f"cast({x!r} as {kind})" if kind == "double" else str(x) for x in getattr(self, name)) + ")")

    def score(self, x: Column) -> Column:
        """Mean vote of the trees on a feature array."""
        feature, left, right, roots = (self._literal(n, "int") for n in ("feature", "left", "right", "roots"))
        threshold, value = self._literal("threshold", "double"), self._literal("value", "double")
        steps = F.sequence(F.lit(1), F.lit(DEPTH))

        def leaf(x: Column, root: Column) -> Column:
            return F.aggregate(steps, root, lambda n, _: F.when(F.get(left, n) < 0, n).otherwise(F.when(F.get(x, F.get(feature, n)) <= F.get(threshold, n), F.get(left, n)).otherwise(F.get(right, n))))

        # the array is bound to a lambda's variable, so that it is made once for all trees
        votes = F.transform(F.array(x), lambda x: F.aggregate(roots, F.lit(0.0), lambda s, r: s + F.get(value, leaf(x, r))))
        return F.get(votes, F.lit(0)) / F.lit(float(len(self.roots)))

    def score_rows(self, rows: np.ndarray) -> np.ndarray:
        """The same on the driver, for tests and held-out accuracy."""
        out = np.zeros(len(rows))
        for i, x in enumerate(rows):
            for n in self.roots:
                while self.left[n] >= 0:
                    n = self.left[n] if x[self.feature[n]] <= self.threshold[n] else self.right[n]
                out[i] += self.value[n]
        return out / len(self.roots)


def _split(x: np.ndarray, y: np.ndarray, columns: np.ndarray) -> tuple[float, int, float]:
    best = (np.inf, -1, 0.0)
    for c in columns:
        order = np.argsort(x[:, c], kind="stable")
        v, t = x[order, c], np.cumsum(y[order])
        n = np.arange(1, len(v))
        ok = (v[1:] > v[:-1]) & (n >= LEAF) & (len(v) - n >= LEAF)
        if not ok.any():
            continue
        p, q = t[:-1] / n, (t[-1] - t[:-1]) / (len(v) - n)
        cost = np.where(ok, n * p * (1 - p) + (len(v) - n) * q * (1 - q), np.inf)
        i = int(cost.argmin())
        if cost[i] < best[0]:
            best = (float(cost[i]), int(c), float((v[i] + v[i + 1]) / 2))
    return best


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, seed: int = 11) -> Forest:
    """Bootstrap rows, a random third of the features at each node, Gini cost."""
    rng = np.random.default_rng(seed)
    nodes: list[list] = []
    roots = []

    def build(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([0, 0.0, -1, -1, float(y[rows].mean())])
        if depth and 0 < y[rows].sum() < len(rows) and len(rows) >= 2 * LEAF:
            cost, c, t = _split(x[rows], y[rows], rng.permutation(x.shape[1])[: max(2, x.shape[1] // 3)])
            if c >= 0:
                side = x[rows, c] <= t
                nodes[at][0:2] = [c, t]
                nodes[at][2] = build(rows[side], depth - 1)
                nodes[at][3] = build(rows[~side], depth - 1)
        return at

    for _ in range(trees):
        roots.append(build(rng.integers(0, len(y), len(y)), DEPTH))
    return Forest(*(tuple(n[i] for n in nodes) for i in range(5)), tuple(roots))


def example_findings(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """n labelled findings (value, path, before, after, label), the same for every call."""
    words = "array('" + "','".join(sorted(set(_WORDS.split("|")))) + "')"
    pick = lambda salt, of: f"element_at({of}, cast(pmod(xxhash64(id, {salt}), size({of})) + 1 as int))"
    hexes = "concat(sha2(cast(id as string), 256), sha2(concat('a', id), 256))"
    b64 = "translate(base64(unhex(sha2(concat('b', id), 512))), '=', '')"
    mixed = f"concat({pick(1, words)}, '{{0}}', {pick(2, words)}, '{{0}}', {pick(3, words)})"
    parts = "array('ba','ber','sch','ung','tion','men','lo','ri','keit','st','er','te','na','pf','ow','qua','zi','ent','ou','gra')"
    syllables = f"concat({', '.join(pick(k, parts) for k in range(20, 27))})"
    secret = [
        f"substr({hexes}, 1, 40)", f"substr({hexes}, 1, 32)", f"substr({hexes}, 1, 64)", f"upper(substr({hexes}, 1, 40))", f"substr({b64}, 1, 40)", f"substr({b64}, 1, 24)",
        f"concat('AKIA', upper(translate(substr({b64}, 1, 16), '+/', 'QZ')))", f"concat('ghp_', translate(substr({b64}, 1, 36), '+/', 'aZ'))", f"concat('sk-', translate(substr({b64}, 1, 48), '+/', 'aZ'))", f"concat(substr({b64}, 1, 10), '7')",
    ]
    innocent = [
        mixed.format("_"), mixed.format("-"), mixed.format("/"), f"concat({pick(1, words)}, initcap({pick(2, words)}), initcap({pick(3, words)}), id)", "substr(concat('4', abs(xxhash64(id)), '0000000000000000'), 1, 16)",
        "repeat('x', 16 + cast(id % 20 as int))", f"concat('your_', {pick(1, words)}, '_here_', id)", f"substr({hexes}, 1, 40)", f"concat({pick(4, words)}, '/', {pick(5, words)}, '/', substr({hexes}, 1, 6), '/', {pick(6, words)})",
        f"concat_ws('-', substr({hexes}, 1, 8), substr({hexes}, 9, 4), substr({hexes}, 13, 4), substr({hexes}, 17, 4), substr({hexes}, 21, 12))", "'================================'", "lpad(id, 20, '0')", f"concat({pick(1, words)}, {pick(2, words)}, {pick(3, words)}, {pick(4, words)})", f"concat({pick(1, words)}, '123')",
        f"upper(concat({pick(1, words)}, {pick(2, words)}, {pick(3, words)}))", f"upper({syllables})", syllables, f"initcap({syllables})",
    ]
    s, i = f"array({', '.join(secret)})", f"array({', '.join(innocent)})"
    rows = spark.range(0, n, 1, 1).selectExpr("id", "cast(pmod(xxhash64(id, 77), 100) < 50 as int) AS label")
    rows = rows.selectExpr("*", f"pmod(xxhash64(id, 5), {len(secret)}) AS a", f"pmod(xxhash64(id, 6), {len(innocent)}) AS b")
    rows = rows.selectExpr("*", f"if(label = 1, {s}[cast(a as int)], {i}[cast(b as int)]) AS value", "label = 0 AND b IN (7, 9) AS digest")
    named = "array('token = \"', 'TOKEN = \"', 'api_key: ', 'secret=', 'password = \"', 'auth_token: \"', 'client_secret = \\'', 'ACCESS_KEY=', 'the token ')"
    hashed = "array('commit ', 'sha1: ', 'md5 = ', 'integrity \"', 'checksum: ', 'uuid=\"', 'revision ')"
    plain = "array('', ' see ', ' the ', 'path = \"', ' of the ', 'class ', ' = \"', 'href=\"', 'token = \"', 'password: ', 'name: ')"
    lead = f"CASE WHEN label = 1 THEN if(pmod(xxhash64(id, 8), 10) < 9, {pick(9, named)}, ' ') WHEN digest THEN {pick(10, hashed)} ELSE {pick(11, plain)} END"
    rows = rows.selectExpr("value", "label", f"concat({pick(12, words)}, ' ', {lead}) AS before", "element_at(array('src/app/main.py', 'config/settings.yml', 'deploy/run.sh', 'src3', 'tests/fixtures/keys.py', 'docs/example.md', 'package-lock.json'), cast(if(label = 1, pmod(xxhash64(id, 13), 5), pmod(xxhash64(id, 13), 7)) + 1 as int)) AS path")
    return rows.withColumn("after", F.expr("if(before LIKE '%\"' OR before LIKE \"%'\", substr(before, -1), ' ')"))


def train(findings: DataFrame, *, most: int = MOST_FINDINGS, seed: int = 11) -> Forest:
    """A forest from labelled findings (value, path, before, after, label 0/1)."""
    order = F.xxhash64("value", "path", "before", "after")
    x = features(F.col("value"), F.col("path"), F.col("before"), F.col("after"))
    rows = findings.where(F.col("value").isNotNull() & F.col("label").isNotNull()).orderBy(order).limit(most).select(x.alias("x"), "label").collect()
    return grow(np.array([r["x"] for r in rows]), np.array([float(r["label"]) for r in rows]), seed=seed)


@functools.lru_cache(1)
def _built_in(application: str) -> Forest:
    spark = SparkSession.getActiveSession()
    return train(example_findings(spark))


def built_in_forest(spark: SparkSession) -> Forest:
    """Trained once in an application from the built-in findings."""
    return _built_in(spark.sparkContext.applicationId)


_STEP = 256


def with_candidates(docs: DataFrame, forest: Forest, *, text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """docs: without columns of those names. Adds __cut (gap and candidate together), __found (start, value, score) and __end (what they take of the text)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    out = docs.withColumn("__cut", F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    out = out.withColumn("__value", F.when(F.size("__cut") > 0, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(2))).otherwise(F.expr("cast(array() as array<string>)")))
    out = out.withColumn("__sizes", F.transform("__cut", lambda x: F.length(x).cast("long")))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    # sums of _STEP sizes, and the sums of those before: ends are found without going over all sizes each time
    blocks = F.when(F.size("__sizes") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("__sizes") - 1) / _STEP).cast("int")), lambda j: total(F.slice(F.col("`__sizes`"), j * _STEP + 1, F.lit(_STEP))))).otherwise(F.expr("cast(array() as array<bigint>)"))
    out = out.withColumn("__blocks", blocks)
    out = out.withColumn("__upto", F.transform("__blocks", lambda _, j: total(F.slice(F.col("`__blocks`"), F.lit(1), j))))
    out = out.withColumn("__end", total(F.col("`__sizes`")))
    cuts, sizes, upto, end = (F.col(f"`__{x}`") for x in ("cut", "sizes", "upto", "end"))
    rest = F.when(F.size(cuts) > 0, F.substring(text, (end + 1).cast("int"), F.lit(NEAR)))
    out = out.withColumn("__rest", rest)

    def finding(value: Column, i: Column) -> Column:
        block = F.floor(i / _STEP).cast("int")
        stop = F.get(upto, block) + total(F.slice(sizes, block * _STEP + 1, i % _STEP + 1))
        cut = F.get(cuts, i)
        gap = F.length(cut) - F.length(value)
        before = F.substring(cut, F.greatest(gap - NEAR + 1, F.lit(1)), F.least(gap, F.lit(NEAR)))
        after = F.coalesce(F.substring(F.get(cuts, i + 1), F.lit(1), F.lit(NEAR)), F.col("`__rest`"), F.lit(""))
        score = forest.score(features(value, path, before, after))
        return F.struct((stop - F.length(value)).alias("start"), value.alias("value"), score.alias("score"))

    return out.withColumn("__found", F.transform("__value", finding)).drop("__value", "__sizes", "__blocks", "__upto", "__rest")


def scan(docs: DataFrame, forest: Forest | None = None, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each candidate: id, start, length, value, score, is_secret."""
    forest = forest or built_in_forest(docs.sparkSession)
    path = F.col(f"`{path_col}`") if path_col else F.lit(None)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), path.cast("string").alias("path"))
    found = with_candidates(rows, forest, text_col="text", path_col="path")
    # explode() would infer a filter on the array's size, which is pushed below and makes the array there once more
    out = found.select("id", F.explode_outer("__found").alias("x")).where("x IS NOT NULL")
    return out.select(F.col("id").alias(id_col), "x.start", F.length("x.value").cast("long").alias("length"), "x.value", "x.score", (F.col("x.score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, forest: Forest | None = None, *, text_col: str = "text", path_col: str | None = "source", length_col: str | None = None, threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """docs with every secret replaced by a mask; texts without one stay as they are.

    The columns of docs travel in one struct, so no helper can have the name of one.
    """
    forest = forest or built_in_forest(docs.sparkSession)
    path = F.col(f"`{path_col}`") if path_col else F.lit(None)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"), path.cast("string").alias("path"))
    found = with_candidates(rows, forest, text_col="text", path_col="path")
    parts = F.zip_with("__cut", "__found", lambda cut, x: F.when(x["score"] >= threshold, F.concat(F.substring(cut, F.lit(1), F.length(cut) - F.length(x["value"])), F.lit(mask))).otherwise(cut))
    rest = F.substring(F.col("text"), (F.col("`__end`") + 1).cast("int"), F.length("text"))
    has = F.exists("__found", lambda x: x["score"] >= threshold)
    out = found.select("row", F.when(has, F.concat(F.array_join(parts, ""), rest)).alias("masked"))
    own, masked = F.col("row").getField, F.col("masked")
    changed = {text_col: masked}
    if length_col:
        changed[length_col] = F.length(masked).cast(docs.schema[length_col].dataType)
    return out.select(*[(F.when(masked.isNull(), own(c)).otherwise(changed[c]) if c in changed else own(c)).alias(c) for c in docs.columns])
