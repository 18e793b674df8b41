"""Secret scans with a random forest that removes false positives, in SQL expressions only.

Patterns propose candidates; features are their length, character transitions, dictionary
coverage, the path-like shape around them and the neighbouring words. The forest is fitted on a
bounded table of labelled findings and becomes one SQL expression, so that scanning is a map
without shuffle, Python or explode: whole texts stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeframe.llm.common import table

#: Rules by name, first fit wins; each is matched against a part of a word stripped of the signs around it.
RULES = (
    ("aws_access_key", r"^(?:AKIA|ASIA|AGPA|AROA)[A-Z0-9]{16}$"),
    ("github_token", r"^gh[pousr]_[A-Za-z0-9]{36,}$"),
    ("slack_token", r"^xox[abprs]-[A-Za-z0-9-]{10,}$"),
    ("stripe_key", r"^[sr]k_(?:live|test)_[A-Za-z0-9]{16,}$"),
    ("json_web_token", r"^eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*$"),
    ("assigned", r"(?i)^[a-z0-9_.-]*(?:pass(?:word|wd)?|secret|token|api_?key|auth|access_?key|credential)[a-z0-9_.-]*[=:][\"']?[^\s\"']{8,}$"),
    ("hex_string", r"^[0-9a-f]{20,}$"),
    ("opaque_string", r"^(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}$"),
)
#: A cheap first look at a word, which all that RULES accept passes: a long run of such characters, or a name that assigns.
_LOOK = r"[A-Za-z0-9+/_=.:-]{14,}|(?i:pass|secret|token|api_?key|auth|access_?key|credential)[A-Za-z0-9_.-]*[\"']*[=:]"
#: Quotes beside the sign of an assignment, and where a word's parts end: at quotes and before further assignments.
_QUOTES = r"[\"']+(?=[=:])|(?<=[=:])[\"']+"
_PARTS = r"[\"']+|[&,;?{(\[|]+(?=[A-Za-z_][A-Za-z0-9_.-]*[=:])"
#: What RULES other than 'assigned' accept, inside a part that none accepts as a whole.
_INSIDE = r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA|AGPA|AROA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*|[0-9a-f]{20,})(?![A-Za-z0-9])|(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}"
#: The one kind of several words: what stands between a private key's first and last line.
_BLOCK = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----\s*+([A-Za-z0-9+/=\s:,-]{16,}?)\s*+-----END "
#: Names that announce a secret, and words that announce something harmless.
ANNOUNCE = r"(?i)(?:pass(?:word|wd|phrase)?|secret|token|api.?key|access.?key|auth|bearer|credential|private)"
HARMLESS = r"(?i)(?:^|[^a-z])(?:sha-?\d*|md5|checksum|commit|revision|digest|etag|uuid|guid|hash|version|example|sample|dummy|placeholder|your|isbn|build|integrity)(?:$|[^a-z])"
#: Words whose share of a candidate is its dictionary coverage.
DICTIONARY = ("example", "sample", "dummy", "test", "placeholder", "changeme", "your", "password", "secret", "token", "user", "name", "admin", "default", "config", "value", "string", "index", "main", "data", "file", "path", "home", "http", "https", "www", "com", "org", "net", "html", "page", "image", "class", "function", "return", "object", "array", "list", "item", "get", "set", "the", "and", "for", "with", "from", "this", "that", "not", "key", "api", "app", "lib", "src", "node", "module", "version", "service", "server", "client", "error", "handler", "manager", "factory", "provider", "session")
#: Pairs of letters common in prose of European languages.
COMMON_PAIRS = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de", "hi", "ri", "ro", "ic", "ne", "ea", "ra", "ce", "li", "ch", "ll", "be", "ma", "si", "om", "ur", "ie", "ei", "ue", "qu", "la", "el", "os", "un", "ge", "sc")
#: Bound of the labelled findings that the forest is fitted on.
FIT_ROWS = 6_000
TREES, DEPTH, TRIES, LEAF = 24, 7, 4, 4
SEED = 7
THRESHOLD = 0.5

FEATURES = ("length", "class_changes", "common_pairs", "digits", "capitals", "symbols", "distinct", "dictionary", "slashes", "dots", "at_signs", "announced", "harmless", "prefixed", "hex_only")


def _bare(word: str) -> str:
    """SQL: a word without quotes, brackets and other signs around it."""
    return f"regexp_replace({word}, '^[^A-Za-z0-9]+|[^A-Za-z0-9=]+$', '')"


def _secret(bare: str) -> str:
    """SQL: the candidate in a bare word: what an assignment assigns, or all of it."""
    return f"regexp_replace({bare}, '^[A-Za-z0-9_.-]{{3,30}}[=:][\\x22\\x27]?(?=.)', '')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _features(word: str, secret: str, before: str, after: str) -> list[str]:
    """SQL for FEATURES as doubles."""
    n = f"greatest(1, length({secret}))"
    share = lambda p: f"(regexp_count({secret}, {_quoted(p)}) / {n})"
    classes = f"translate({secret}, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', '{'l' * 26}{'u' * 26}{'d' * 10}')"
    near = f"concat_ws(' ', {before}, regexp_extract({word}, '^([A-Za-z0-9_.-]+)[=:]', 1))"
    pairs = "(?i)(?=" + "|".join(COMMON_PAIRS) + ")"
    return [
        f"CAST(length({secret}) AS DOUBLE)",
        f"(regexp_count({classes}, '(?=lu|ul|ld|dl|ud|du)') / {n})",
        share(pairs),
        share("[0-9]"),
        share("[A-Z]"),
        share("[^A-Za-z0-9]"),
        f"(size(array_distinct(split({secret}, ''))) / sqrt({n}))",
        f"(1 - length(regexp_replace(lower({secret}), '{'|'.join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))}', '')) / {n})",
        f"CAST(regexp_count({secret}, '/') AS DOUBLE)",
        f"CAST(regexp_count({secret}, '[.]') AS DOUBLE)",
        f"CAST(regexp_count({word}, '@') AS DOUBLE)",
        f"CAST({near} RLIKE {_quoted(ANNOUNCE)} AS DOUBLE)",
        f"CAST(concat_ws(' ', {near}, {after}) RLIKE {_quoted(HARMLESS)} AS DOUBLE)",
        f"CAST({secret} RLIKE {_quoted('^(?:AKIA|ASIA|AGPA|AROA|gh[pousr]_|xox[abprs]-|[sr]k_live_|eyJ)')} AS DOUBLE)",
        f"CAST({secret} RLIKE '^[0-9a-f]+$' AS DOUBLE)",
    ]


def _rule(word: str, secret: str) -> str:
    """SQL: the first rule that fits, or null."""
    return f"CASE {' '.join(f'WHEN {word if name == "assigned" else secret} RLIKE {_quoted(pattern)} THEN {_quoted(name)}' for name, pattern in RULES)} END"


def _parts(word: str) -> str:
    """SQL: array of struct(word, secret, rule) of what rules accept in a word: its parts, matches inside the others, all of it if its first part is none."""
    unit = lambda nth, x: f"element_at(transform(transform(array({_bare(x)}), b -> named_struct('nth', {nth}, 'word', b, 'secret', {_secret('b')})), u -> named_struct('nth', u.nth, 'word', u.word, 'secret', u.secret, 'rule', {_rule('u.word', 'u.secret')})), 1)"
    split = f"filter(split(regexp_replace({word}, {_quoted(_QUOTES)}, ''), {_quoted(_PARTS)}), x -> length(x) >= 8)"
    units = f"transform({split}, (x, nth) -> {unit('nth', 'x')})"
    whole = f"filter(array({unit('-1', word)}), u -> u.rule IS NOT NULL AND NOT exists(us, v -> v.nth = 0 AND v.rule IS NOT NULL))"
    inside = f"flatten(transform(filter(us, u -> u.rule IS NULL), u -> transform(regexp_extract_all(u.word, {_quoted(_INSIDE)}, 0), s -> named_struct('nth', u.nth, 'word', u.word, 'secret', s, 'rule', {_rule("''", 's')}))))"
    # quotes taken out of a part are in the text: what isn't there can't be masked
    return f"filter(element_at(transform(array({units}), us -> concat({whole}, us, {inside})), 1), u -> u.rule IS NOT NULL AND contains({word}, u.secret))"


def findings(text: str) -> str:
    """SQL: array of struct(at, word, secret, rule, before, after) of what rules propose in a text, in the order of its words; private key blocks come last."""
    looks = f"length(ws[i]) >= 13 AND ws[i] RLIKE {_quoted(_LOOK)}"
    found = f"flatten(transform(filter(sequence(0, size(ws) - 1), i -> {looks}), i -> transform({_parts('ws[i]')}, p -> named_struct('at', i, 'word', p.word, 'secret', p.secret, 'rule', p.rule, 'before', concat_ws(' ', get(ws, i - 2), get(ws, i - 1)), 'after', coalesce(get(ws, i + 1), '')))))"
    # the array of one split text keeps it from being split again for each use
    spaces = r"'[\\x20\\x09-\\x0D]+'"
    at = f"size(split(substr({text}, 1, greatest(instr({text}, k) - 1, 0)), {spaces})) - 1"
    block = f"transform(regexp_extract_all({text}, {_quoted(_BLOCK)}, 1), k -> named_struct('at', {at}, 'word', k, 'secret', k, 'rule', 'private_key', 'before', 'PRIVATE KEY', 'after', ''))"
    words = f"element_at(transform(array(split({text}, {spaces})), ws -> {found}), 1)"
    return f"IF(contains({text}, ' PRIVATE KEY-----'), concat({words}, {block}), {words})"


def _named(found: str) -> str:
    """SQL: the findings with their features."""
    return f"transform({found}, f -> named_struct('at', f.at, 'secret', f.secret, 'rule', f.rule, 'x', array({', '.join(_features('f.word', 'f.secret', 'f.before', 'f.after'))})))"


def labelled_findings(spark: SparkSession, rows: int = FIT_ROWS) -> DataFrame:
    """(text, label): made-up findings in one line of prose each, from a seeded rule.

    Label 1: keys with known prefixes, tokens and passwords assigned to such names, opaque
    strings after announcing words, private keys. Label 0: certificates, long numbers, digests and ids after words that name them, UUIDs,
    paths, addresses, identifiers, placeholders, phone-like numbers, and long words of prose.
    """
    rand = lambda salt, n, alphabet: f"concat_ws('', transform(sequence(1, CAST({n} AS INT)), k -> substr('{alphabet}', CAST(1 + pmod(xxhash64(id, k, '{salt}'), {len(alphabet)}) AS INT), 1)))"
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    pick = lambda salt, *xs: f"element_at(array({', '.join(map(_quoted, xs))}), CAST(1 + pmod(xxhash64(id, '{salt}'), {len(xs)}) AS INT))"
    word = lambda salt: pick(salt, *DICTIONARY)
    n = lambda salt, a, b: f"({a} + pmod(xxhash64(id, '{salt}'), {b - a + 1}))"
    name = pick("name", "token", "secret", "api_key", "password", "access_key", "auth_token", "client_secret", "passwd")
    sign = pick("sign", " = ", "=", ": ", " : ", "=")
    quote = pick("quote", '"', "'", "")
    good = [
        f"concat('AKIA', {rand('a', 16, up + '234567')})",
        f"concat('ghp_', {rand('b', 36, low + up + dig)})",
        f"concat('sk_live_', {rand('c', 24, low + up + dig)})",
        f"concat('xoxb-', {rand('d', 12, dig)}, '-', {rand('e', 24, low + up + dig)})",
        f"concat('eyJ', {rand('f', 20, low + up + dig)}, '.eyJ', {rand('g', 40, low + up + dig)}, '.', {rand('h', 43, low + up + dig + '_-')})",
        f"concat({name}, {sign}, {quote}, {rand('i', 40, hexa)}, {quote})",
        f"concat({name}, '=', {rand('j', n('jn', 16, 24), hexa)})",
        f"concat({name}, {sign}, {quote}, {rand('k', n('kn', 20, 44), low + up + dig + '+/')}, {quote})",
        f"concat({name}, '=', {rand('l', n('ln', 12, 24), low + up + dig)})",
        f"concat({pick('w', 'Bearer ', 'Authorization: Bearer ', 'token ', 'access key ')}, {rand('w', n('wn', 20, 44), hexa)})",
        f"concat('-----BEGIN ', {pick('z', 'RSA ', 'EC ', 'OPENSSH ', '')}, 'PRIVATE KEY----- ', {rand('z1', 64, low + up + dig + '+/')}, ' ', {rand('z2', n('zn', 20, 64), low + up + dig + '+/')}, ' -----END PRIVATE KEY-----')",
    ]
    bad = [
        f"concat({pick('m', 'commit ', 'sha1: ', 'checksum ', 'md5 = ', 'revision ', 'digest: ', 'etag ')}, {rand('m', n('mn', 32, 64), hexa)})",
        f"concat({pick('n', 'uuid ', 'id ', 'guid: ', '')}, {rand('n1', 8, hexa)}, '-', {rand('n2', 4, hexa)}, '-', {rand('n3', 4, hexa)}, '-', {rand('n4', 12, hexa)})",
        f"concat('/', {word('o1')}, '/', {word('o2')}, '/', initcap({word('o3')}), {word('o4')}, {rand('o', 3, dig)}, '/', {word('o5')})",
        f"concat('https://', {word('p1')}, '.example.com/', {word('p2')}, '/', {rand('p', 6, dig)}, '?ref=', {word('p3')})",
        f"concat(initcap({word('q1')}), initcap({word('q2')}), initcap({word('q3')}), initcap({word('q4')}), {rand('q', 2, dig)})",
        f"concat({name}, {sign}, {pick('r', 'YOUR_TOKEN_GOES_HERE', 'xxxxxxxxxxxxxxxxxxxx', 'example-password-123', 'changeme-changeme-1', '<insert-your-key-here>', '********************', '${{SECRET_FROM_ENV}}')})",
        f"concat('AKIA', {pick('s', 'IOSFODNN7EXAMPLE', 'XXXXXXXXXXXXXXXX', 'EXAMPLEEXAMPLE12', '0000000000000000')})",
        f"concat({rand('t', 4, dig)}, '-', {rand('t2', 4, dig)}, '-', {rand('t3', 4, dig)}, '-', {rand('t4', 4, dig)})",
        f"concat(initcap({word('u1')}), {word('u2')}, {word('u3')}, {word('u4')}, {rand('u', 1, dig)})",
        f"concat('integrity sha512-', {rand('v', 60, low + up + dig + '+/')}, '==')",
        f"concat('-----BEGIN CERTIFICATE----- MII', {rand('c1', 61, low + up + dig + '+/')}, ' -----END CERTIFICATE-----')",
        f"concat({pick('d1', 'serial ', 'order ', 'account ', '')}, {rand('d1', n('dn', 20, 26), dig)})",
    ]
    cases = lambda xs, salt: f"CASE pmod(xxhash64(id, '{salt}'), {len(xs)}) {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(xs))} END"
    prose = lambda salt: pick(salt, "the", "we set", "one finds", "see", "and then", "la", "der", "une", "with", "value", "here", "stored in", "note")
    return spark.range(rows).selectExpr("CAST(id % 2 AS DOUBLE) AS label", f"concat_ws(' ', {prose('x')}, {prose('y')}, CASE WHEN id % 2 = 1 THEN {cases(good, 'good')} ELSE {cases(bad, 'bad')} END, {prose('z')}) AS text")


def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> tuple | float:
    """A node (feature, threshold, low side, high side) or a leaf's share of label 1."""
    if depth == 0 or len(y) < 2 * LEAF or y.min() == y.max():
        return float((y.sum() + 0.5) / (len(y) + 1))
    best = None
    for f in rng.permutation(x.shape[1])[:TRIES]:
        order = np.argsort(x[:, f], kind="stable")
        v, c = x[order, f], np.cumsum(y[order])
        k = np.nonzero(v[1:] > v[:-1])[0]
        k = k[(k + 1 >= LEAF) & (len(y) - k - 1 >= LEAF)]
        if len(k):
            left, right, ones = k + 1, len(y) - k - 1, c[k]
            gini = ones * (left - ones) / left + (c[-1] - ones) * (right - c[-1] + ones) / right
            i = int(gini.argmin())
            if best is None or gini[i] < best[0]:
                best = (gini[i], int(f), float((v[k[i]] + v[k[i] + 1]) / 2))
    if best is None:
        return float((y.sum() + 0.5) / (len(y) + 1))
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[low], y[low], depth - 1, rng), _grow(x[~low], y[~low], depth - 1, rng)


def _tree_sql(node: tuple | float) -> str:
    if isinstance(node, float):
        return f"{node:.6f}D"
    f, at, low, high = node
    return f"IF(v[{f}] <= {at!r}D, {_tree_sql(low)}, {_tree_sql(high)})"


def train(labelled: DataFrame) -> str:
    """Fit the forest on labelled findings (text, label) and return SQL for a probability from features ``v``.

    At most FIT_ROWS findings, in the order of a hash so that both labels keep their shares, reach
    the driver, as numbers only. Every finding in a row has the row's label. Rows with null label
    or text, or in which no rule proposes a finding, count for nothing: they would not be found
    either. Other columns are ignored.
    """
    made = labelled.where("label IS NOT NULL").selectExpr("CAST(label AS DOUBLE) AS label", f"explode({_named(findings('text'))}.x) AS x")
    made = made.orderBy(F.xxhash64("label", "x"), "label", "x").limit(FIT_ROWS).collect()
    if len({r.label for r in made}) < 2:
        raise ValueError("labelled findings of both kinds are needed")
    x, y = np.array([r.x for r in made]), np.array([r.label for r in made])
    rng = np.random.default_rng(SEED)
    trees = []
    for _ in range(TREES):
        rows = rng.integers(0, len(y), len(y))
        trees.append(_grow(x[rows], y[rows], DEPTH, rng))
    return "(" + " + ".join(map(_tree_sql, trees)) + f") / {TREES}D"


def scan(docs: DataFrame, forest: str, text_col: str = "text") -> Column:
    """Array of struct(at, secret, rule, probability): every proposed finding of a text, several of a word too; null for a null text."""
    proposed = f"transform({_named(findings(f'`{text_col}`'))}, f -> named_struct('at', f.at, 'secret', f.secret, 'rule', f.rule, 'probability', element_at(transform(array(f.x), v -> {forest}), 1)))"
    return F.expr(proposed)


def find_secrets(docs: DataFrame, forest: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per proposed finding: id, at (word number from 0), rule, secret, probability, is_secret.

    Null and empty texts have none. Repeated rows are each reported. Other columns are ignored.
    No shuffle.
    """
    found = docs.select(F.col(id_col).alias("id"), F.explode(scan(docs, forest, text_col)).alias("f"))
    return found.select("id", "f.at", "f.rule", "f.secret", "f.probability", (F.col("f.probability") >= THRESHOLD).alias("is_secret"))


def redact(docs: DataFrame, forest: str, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each confirmed secret replaced by ``mask`` everywhere in its text; all rows and columns stay."""
    # the longest first: one may be a part of another
    confirmed = f"array_sort(array_distinct(transform(filter(__found, f -> f.probability >= {THRESHOLD}D), f -> f.secret)), (x, y) -> length(y) - length(x))"
    masked = docs.withColumn("__found", scan(docs, forest, text_col)).withColumn(text_col, F.expr(f"IF(coalesce(size(__found), 0) > 0, aggregate({confirmed}, `{text_col}`, (t, s) -> replace(t, s, '{mask}')), `{text_col}`)"))
    return masked.drop("__found")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"), train(labelled_findings(spark))).withColumnRenamed("id", "doc_id")
