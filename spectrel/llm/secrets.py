"""Secrets in texts: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

A candidate's features are its length, character transitions, dictionary coverage, path marks and neighbouring words.
The forest (MLlib) is trained on labelled findings; ``labelled_texts`` makes the built-in ones from a rule, and a table of
reviewed findings can be given instead. Nothing is shuffled: candidates stay with the rows of their text.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, whole_rows

# Patterns of candidates, in Java's syntax. They are wide; the forest removes what is no secret. A key's body
# goes on to its END; without one, past its header lines to the next hyphen. A value in quotes goes on to the closing one,
# blanks and the other quote included. A run of token characters must hold a letter or digit, and isn't a name that a value
# follows. What LEAD matches at the start of a candidate leads up to it: no pattern looks behind itself over more than a
# character.
_RUN = "[A-Za-z0-9+/_.~-]"
_KEY = r"(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
_WORD = "pass(?:word|wd|phrase|code)?|pwd|secret|api[_-]?key|access[_-]?key|auth[_-]?key|account[_-]?key|token|credentials?"
_SIGN = r"[\"']?\s{0,3}(?:=>|:=|[=:])\s{0,3}"
_NAMED = rf"(?i:{_WORD})(?:[_-][A-Za-z0-9_-]{{0,24}}+)?{_SIGN}"
_HEADER = rf"(?i:authorization){_SIGN}[\"']?(?i:basic|bearer|token|apikey)\s+"
PATTERNS = {
    "private_key": rf"-----BEGIN {_KEY}(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END {_KEY}|(?:\s*+(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset)[^\n]*+)*+[^-]*+)",
    "url_login": r"://[^\s/:@\"']*+:[^\s/@\"']++(?=@)",
    "header": rf"{_HEADER}[^\s\"'<>,;]{{6,}}+",
    "assigned": rf"{_NAMED}(?:\"[^\"\n]{{4,}}+(?=\")|'[^'\n]{{4,}}+(?=')|[^\s\"'<>,;=:][^\s\"'<>,;]{{3,}}+)",
    "token": rf"(?<!{_RUN})(?=[+/_.~-]*+[A-Za-z0-9]){_RUN}{{16,}}+(?:={{1,2}}+(?![\"'A-Za-z0-9]))?+(?![\"']?\s?(?:=>|:=|[=:])\s?[\"'A-Za-z0-9])",
}
CANDIDATE = "|".join(PATTERNS.values())
LEAD = rf"^(?:://|{_HEADER}|{_NAMED}[\"']?)"

# Words of the dictionary, of neighbours that speak for or against a secret, and frequent letter pairs.
DICTIONARY = (
    "about access account action address admin after again all also amount and android any app application area array article asset assets author auth base been before big body book "
    "build button cache call card case cat center change chapter check child city class click client close code color column com comment commit common config content copy core count "
    "country create current data date day default delete desc detail device dir doc document down edit email end error event example export fail family file find first font foot form "
    "format forward from func function get git global go good group guide have head height help high home host how html http https icon id image images img import in index info init "
    "input install int into item java jpg js json key kind label lang large last lib library light line link list load local location lock log login long main make manager map max media "
    "member menu message meta method min mobile mode model module month more move music name nav net new news next node not note null num number object of off old on one open option "
    "order org other out over page panel param parent part pass path pdf people php place plan play plugin png point post preview price print private process product profile project "
    "public python query quick read record ref release remove report request reset resource response rest result review right role root route row run sample save scale score script "
    "search section select send sequence server service session set setting shop show side sign simple site size small source spark sql src stable start state static status step stop "
    "store story string style sub submit summary support sync system tab table tag target task team temp template test text the theme this time title to token tool top track type under "
    "unit update upload url use user util value var vendor version video view web week width window with word work world www year your zip"
).split()
SPEAKS_FOR = "token|secret|api[_ -]?key|apikey|passwd|password|pwd|auth|authorization|bearer|credential|private[_ -]?key|access[_ -]?key|client[_ -]?secret|signature"
SPEAKS_AGAINST = "ssh-rsa|ssh-dss|ssh-ed25519|public[_ -]?key|commit|sha[0-9]*|md5|checksum|hash|etag|uuid|guid|digest|revision|rev|integrity|build|version|phone|card|isbn|doi|order|invoice|serial|href|src|url|path|file|image|blob"
PLACEHOLDER = "example|sample|xxxx|your[_-]?|placeholder|change.?me|dummy|0000000|1234567|abcdefg|\\\\.\\\\.\\\\.|insert|redacted"
KNOWN_PREFIX = "^(AKIA|ASIA|gh[opsu]_|github_pat_|xox[abeprs]-|sk-|[sr]k_live_|AIza|glpat-|npm_|eyJ|SG\\\\.|ya29\\\\.)"
EXTENSION = "\\\\.(js|py|css|html?|php|png|jpe?g|gif|svg|pdf|json|xml|txt|md|java|go|rs|cpp?|h|zip|gz|tar|exe|dll|so|com|org|net)([?/#]|$)"
LETTER_PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce"

FEATURES = [
    "f_length", "f_digits", "f_upper", "f_lower", "f_other", "f_hex", "f_changes", "f_case_changes", "f_pairs", "f_distinct", "f_dictionary", "f_slashes", "f_dots", "f_dashes",
    "f_extension", "f_path_start", "f_for", "f_against", "f_assigned", "f_quoted", "f_placeholder", "f_prefix", "f_uuid", "f_named", "f_word_before", "f_word_after", "f_words", "f_reference", "f_pass",
]
TREES, DEPTH, SEED = 30, 8, 11
#: Labelled findings that the built-in rule makes.
BUILT_IN = 9000
THRESHOLD = 0.5


def suspicious(text: Column) -> Column:
    """Whether a text holds a candidate. The plain searches come first: every pattern needs what one of them looks for."""
    plain = text.rlike(_RUN + "{16}") | text.contains("PRIVATE KEY") | text.contains("://") | text.rlike(f"(?i){_WORD}|authorization")
    return plain & text.rlike(CANDIDATE)


def candidates(texts: DataFrame, text_column: str = "text") -> DataFrame:
    """One row for each candidate: the other columns of ``texts``, and start (code points from 0), found, kind, before, after."""
    text = F.col(text_column)
    hits = texts.where(suspicious(text))
    both = hits.withColumns({"_matches": F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), "_rest": F.split(text, CANDIDATE, -1)}).drop(text_column)
    each = both.select("*", F.posexplode("_matches").alias("_i", "_match"))
    each = each.withColumn("_lead", F.when(F.col("_match").rlike(f"^{_RUN}{{16,}}+={{0,2}}$"), "").otherwise(F.regexp_extract("_match", LEAD, 0)))
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x))
    start = size(F.slice("_rest", 1, F.col("_i") + 1)) + size(F.slice("_matches", 1, F.col("_i"))) + F.length("_lead")
    found = F.substr("_match", F.length("_lead") + 1)
    kind = F.when(F.col("_match").startswith("://"), "url_login").when(F.col("_match").startswith("-----BEGIN"), "private_key").otherwise("token")
    previous = F.concat(F.get("_rest", F.col("_i")), "_lead")
    following = F.get("_rest", F.col("_i") + 1)
    return each.select(
        *[c for c in texts.columns if c != text_column], start.cast("long").alias("start"), found.alias("found"), kind.alias("kind"),
        F.substring(previous, F.greatest(F.length(previous) - 47, F.lit(1)), F.lit(48)).alias("before"), F.substring(following, F.lit(1), F.lit(24)).alias("after"),
    )


def featured(found: DataFrame) -> DataFrame:
    c, low = F.col("found"), F.lower("found")
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    left, right = F.lower("before"), F.col("after")
    count = lambda col, pattern: F.regexp_count(col, F.lit(pattern)).cast("double")
    is_ = lambda test: test.cast("double")
    near = lambda words: left.rlike(f"({words})([_-][a-z0-9_-]{{0,24}})?[^a-z0-9]{{0,8}}((basic|bearer|token) )?$")
    changes = count(c, "(?<=[0-9])(?=[A-Za-z])") + count(c, "(?<=[A-Za-z])(?=[0-9])")
    columns: dict[str, Column] = {
        "f_length": F.least(n, F.lit(400.0)),
        "f_digits": count(c, "[0-9]") / n,
        "f_upper": count(c, "[A-Z]") / n,
        "f_lower": count(c, "[a-z]") / n,
        "f_other": count(c, "[^A-Za-z0-9]") / n,
        "f_hex": count(low, "[0-9a-f]") / n,
        "f_changes": changes / n,
        "f_case_changes": count(c, "(?<=[a-z])(?=[A-Z])") / n,
        "f_pairs": count(low, f"(?={LETTER_PAIRS})") / n,
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))).cast("double") / n,
        "f_dictionary": 1 - F.length(F.regexp_replace(low, "(" + "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w))) + ")", "")) / n,
        "f_slashes": count(c, "/"),
        "f_dots": count(c, "\\."),
        "f_dashes": count(c, "[-_]"),
        "f_extension": is_(low.rlike(EXTENSION.replace("\\\\", "\\"))),
        "f_path_start": is_(c.rlike("^[/.~]")),
        "f_for": is_(near(SPEAKS_FOR)),
        "f_against": is_(near(SPEAKS_AGAINST)),
        "f_assigned": is_(F.col("before").rlike("[=:]\\s?[\"'`]?$")),
        "f_quoted": is_(right.rlike("^[\"'`]")),
        "f_placeholder": is_(low.rlike(PLACEHOLDER.replace("\\\\", "\\"))),
        "f_prefix": is_(c.rlike(KNOWN_PREFIX.replace("\\\\", "\\"))),
        "f_uuid": is_(low.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")),
        "f_named": is_(F.col("kind") != "token"),
        "f_word_before": is_(left.rlike("[a-z]{2,} $")),
        "f_words": count(c, "\\s"),
        "f_reference": is_(c.rlike("^[$%{<&(*]|[({]$|[A-Za-z]\\(|^(self|this|process|os|env|settings|config|request|params|args|options|props|data|user)[.\\[]|[.](env|environ|get|config|settings)\\b")),
        "f_pass": is_(left.rlike("(pass(word|wd|phrase|code)?|pwd|secret)([_-][a-z0-9_-]{0,24})?[^a-z0-9]{0,8}$")),
        "f_word_after": is_(right.rlike("^[\"'.,]? ?[A-Za-z]{2,}")),
    }
    return found.withColumns(columns)


#: Forms of labelled findings, a secret (1) or not (0). Braces hold what ``labelled_texts`` puts in: words w, and signs,
#: names, digits d, hexadecimal digits h, base-64 digits b and c, and letters a of the given number.
FORMS = [
    (1, "{name} {sign} {q}{h40}{q}"), (1, "{name} {sign} {q}{h32}{q}"), (1, "{name} {sign} {q}{h64}{q}"), (1, "{name} {sign} {q}{b24}{q}"), (1, "{name} {sign} {q}{b32}{q}"), (1, "{name} {sign} {q}{b40}{q}"),
    (1, "{name}={h40}"), (1, "{name}={b40}"), (1, "Authorization: Bearer {b40}"), (1, "ghp_{b36}"), (1, "AKIA{B16}"), (1, "eyJ{b40}.{c40}"), (1, "{name} {sign} {q}sk_live_{b24}{q}"),
    (1, "https://{w1}:{b12}@{w2}.org/"), (1, "-----BEGIN PRIVATE KEY-----\n{b40}\n{c40}\n-----END PRIVATE KEY-----"), (1, "{name} {sign} {q}xoxb-{d12}-{b24}{q}"),
    (0, "{against} {h40}"), (0, "{against}: {h32}"), (0, "{against} = {q}{h64}{q}"), (0, "{uuid}"), (0, "id = {q}{uuid}{q}"), (0, "/{w1}/{w2}/{w3}/{w4}{d2}{ending}"), (0, "https://www.example.org/{w1}/{w2}/{w3}{d2}{ending}"),
    (0, "{d16}"), (0, "card {d16}"), (0, "{name} {sign} {q}your_{name}_here_1234567{q}"), (0, "{name} {sign} {q}xxxxxxxxxxxxxxxxxxxxxxxx0000{q}"), (0, "{w1}_{w2}_{w3}_{w4}_{d2}"), (0, "{w1}-{w2}-{w3}-{w4}-{d4}"),
    (0, "data:image/png;base64,{b40}{c40}"), (0, "sha512-{b40}{c40}"), (0, "{w1}{W2}{W3}{W4}{d2}{d4}"), (0, "2024-01-{d2}T10:{d2}/2024.02.{d2}-v1.2.3"), (0, "{w1}{d2}{w2}{w3}{w4}"), (0, "{h40}"), (0, "file {h32}.png"),
    (1, '"{pass}": "{w1}{d2}!"'), (1, '"{pass}": "{b12}"'), (1, "{pass}: {W2}{d2}{w1}"), (1, "{pass}: {b8}"), (1, "{pass}={w3}{d1}"), (1, "{pass}={b12}"), (1, "{pass} {sign} {q}{W3}{d1}{W4}{d2}{q}"), (1, "{pass} {sign} {q}{b8}{q}"),
    (1, "{name} {sign} {q}{a24}{q}"), (1, "{name} {sign} {q}{a20}{q}"), (1, "{name}={a24}"), (1, "redis://:{b4}@{w2}.org/"), (1, "redis://:{w3}{d1}@{w2}"), (1, "ftp://{w1}:{b40}{c40}{h40}@{w2}.org/"),
    (0, "{pass}: {w1} {w2}"), (0, "{pass}: {kind}"), (0, "{pass} = {kind}"), (0, '"{pass}": "{kind}"'), (0, "{pass} = get{W2}()"), (0, "{pass}=${w3}"), (0, "{pass}: enter the {w1}"), (0, "{pass} {sign} {q}your_{w1}{q}"),
    (1, "-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: {w1}\n\n{b40}{w2}-{c40}\n={b4}\n-----END PGP PRIVATE KEY BLOCK-----"), (1, "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{h32}\n\n{b40}\n{c40}\n-----END RSA PRIVATE KEY-----"),
    (1, "-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: {W2}-{w3}\n\n{b12}+{w1}\n={b4}\n-----END PGP PRIVATE KEY BLOCK-----"),
    (1, '{pass} {sign} "{w1} {w2} {w3} {w4}"'), (1, "{pass}: '{w3} {w1} {d2} {w4}'"), (1, "{pass} = {q}{b4}'{b4}{q}"), (1, "{PASS}={b12}"), (1, "DB_{PASS}={W2}{d2}{b4}"), (1, "{NAME}_KEY = {q}{w1}-{w2}-{b24}!{b8}{q}"),
    (1, "{name}: {b8}{d2}"), (1, "{name}={b12}"), (1, '"{name}": "{h12}"'), (1, '"{name}": "{b12}"'), (1, "{name} = {q}{b12}{q}"), (1, "Authorization: Basic {b12}"), (1, "Authorization: Basic {b24}=="), (1, "authorization={q}Bearer {h32}{q}"),
    (0, "process.env.{NAME}_VALUE"), (0, "{name} = process.env.{NAME}"), (0, "{pass} = os.environ[{q}{NAME}{q}]"), (0, "{pass}: self.{w1}_{w2}"), (0, "{name} = config.{w1}.{w2}"), (0, "{pass} = request.{w1}[{q}{w2}{q}]"), (0, "ssh-rsa AAAAB3NzaC1yc2E{b40}{c40} {w1}@{w2}"),
    (0, "ssh-ed25519 AAAAC3NzaC1lZDI1{b40}"), (0, "{pass} = {q}{kind}{q}"), (0, "{pass}: {q}{w1}{q}s {w2}"), (0, "{name}: {w1}"), (0, "{name} = {w1}_{w2}"), (0, "{name}={kind}"), (0, '"{name}": "{w1}"'), (0, "{name} {sign} {q}<your {w1}>{q}"), (0, "{PASS}=${{NAME}}"),
    (0, "the {name}: {w1} {w2}"), (0, '"{pass}": "Enter the {w1} for the {w2} here."'), (0, "{pass}: must be at least {d1} characters"), (0, "{name} = new{W2}({w1})"), (0, "Authorization: Bearer <{w1}>"), (0, "Authorization: Basic ${w1}_{w2}"), (0, "{W2}{W3}.{w1}.{NAME}"),
    (0, "{w1}-{w2}-{w3}-{w4}"), (0, "{w1}-of-the-{w2}-{w3}"), (0, "{w1}.{w2}.{w3}.{w4}"), (0, "{w1}_{w2}_{w3}_{w4}"), (0, "{w1}{w2}{w3}{w4}"), (0, "{W2}{w1}{w3}{w4}"), (0, "{W2}{W3}{W4}{W2}"), (0, "/{w1}/{w2}/{w3}/{w4}"),
    (0, "https://www.example.org/{w1}/{w2}/{w3}/"), (0, "====={w1}-{w2}====="), (0, "{w1}@{w2}.{w3}.example.org"), (0, "...{w1}-------------"),
]


def labelled_texts(spark: SparkSession, n: int = BUILT_IN) -> DataFrame:
    """(text, label): ``n`` short texts made from their number alone, each with one finding that is a secret (1) or not (0)."""
    pick = lambda words, salt: F.element_at(F.split(F.lit(words), " "), (F.pmod(F.hash("id", F.lit(salt)), F.lit(len(words.split()))) + 1).cast("int"))
    digest = lambda salt: F.concat(F.sha2(F.concat_ws("/", F.lit(salt), F.col("id")), 256), F.sha2(F.concat_ws("+", F.lit(salt), F.col("id")), 256))
    some = "the of and for with there over window order table return public server method value image report search project update north river stone winter careful morning"
    base = lambda salt: F.regexp_replace(F.base64(F.unhex(digest(salt))), "[=+/\\s]", "k")
    made = spark.range(0, n, 1, 1).select(
        "id",
        *[pick(some, i).alias(f"w{i}") for i in range(8)],
        pick("\" ' \"", 101).alias("q"), pick("= : = =>", 102).alias("sign"), pick(".js .py .png .html .json .pdf", 105).alias("ending"),
        pick("token secret api_key API_KEY apikey auth_token access_token access_key client_secret password TOKEN secret_key private_key", 103).alias("name"),
        pick("password Password PASSWORD passwd pwd secret db_password passphrase", 106).alias("pass"), pick("string None null true false required optional text example", 107).alias("kind"),
        pick("commit sha1 sha256 md5 checksum hash etag digest revision rev build integrity blob", 104).alias("against"),
        digest("h").alias("h"), base("b").alias("b"), base("c").alias("c"), F.regexp_replace(digest("d"), "[a-f]", "").alias("d"),
        F.regexp_replace(F.concat(base("e"), base("f")), "[^A-Za-z]", "").alias("a"),
    )
    # written once, so that no single expression makes everything
    made = stored(made, "findings")
    row = F.pmod("id", F.lit(len(FORMS)))
    text = F.concat_ws(" ", "w5", "w6", "w7", F.element_at(F.array(*[F.lit(t) for _, t in FORMS]), (row + 1).cast("int")), "w0", F.concat("w2", F.lit(".")))
    fill = {c: F.col(c) for c in ("q", "sign", "ending", "name", "against", "pass", "kind", "w1", "w2", "w3", "w4")} | {f"W{i}": F.initcap(f"w{i}") for i in (2, 3, 4)}
    fill |= {f"{c}{size}": F.substring(c, 1, size) for c, sizes in {"h": (12, 32, 40, 64), "b": (4, 8, 12, 24, 32, 36, 40), "c": (40,), "d": (1, 2, 4, 12, 16), "a": (20, 24)}.items() for size in sizes}
    fill |= {"NAME": F.upper("name"), "PASS": F.upper("pass")}
    fill |= {"B16": F.upper(F.substring("b", 1, 16)), "uuid": F.concat_ws("-", *[F.substring("h", at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])}
    for key, value in fill.items():
        text = F.replace(text, F.lit("{" + key + "}"), value)
    labels = F.array(*[F.lit(label) for label, _ in FORMS])
    return made.select(text.alias("text"), F.element_at(labels, (row + 1).cast("int")).alias("label"))


_BUILT_IN: dict[str, RandomForestClassificationModel] = {}


def train(spark: SparkSession, labelled: DataFrame | None = None) -> RandomForestClassificationModel:
    """A forest from labelled texts (text, label): each candidate of a text has the text's label.

    The one of the built-in findings depends on nothing else, so a session trains it once.
    """
    session = spark.sparkContext.applicationId
    if labelled is None and session in _BUILT_IN:
        return _BUILT_IN[session]
    rows = featured(candidates(labelled_texts(spark) if labelled is None else labelled)).select("label", *FEATURES)
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select(F.col("label").cast("double").alias("label"), "features")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", maxMemoryInMB=64).fit(table)
    if labelled is None:
        _BUILT_IN[session] = model
    return model


def scan(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = THRESHOLD) -> DataFrame:
    """Findings that the forest takes for secrets: doc_id, start, length (code points), kind, found (in clear), score.

    Null and empty texts have none; repeated rows give repeated findings; other columns are ignored. A text of any length
    is searched whole, in one row of one task; its findings are rows of their own.
    """
    rows = featured(candidates(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    score = F.element_at(vector_to_array("probability"), 2)
    return scored.select("doc_id", "start", F.length("found").cast("long").alias("length"), "kind", "found", score.alias("score")).where(F.col("score") >= threshold)


def redact(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = THRESHOLD, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each secret in text replaced by ``mark`` and n_chars counted anew; all rows and columns stay.

    Texts with a finding, of any length, are put together again from the pieces between secrets; no other row leaves its
    partition. Columns may have any names.
    """
    suspects = stored(docs.where(suspicious(F.col("text"))).select(F.monotonically_increasing_id().alias("row"), "text", whole_rows(docs)), "suspects")
    rest = docs.where(~F.coalesce(suspicious(F.col("text")), F.lit(False)))
    found = scan(suspects.select(F.col("row").alias("doc_id"), "text"), model, threshold).groupBy(F.col("doc_id").alias("row")).agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("spans"))
    both = suspects.join(found, "row", "left")
    step = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, x: F.struct(F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mark)).alias("out"), (x["start"] + x["length"]).alias("at")),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))),
    )
    changed = both.select(*[F.coalesce(step, "text").alias(c) if c == "text" else F.col("whole")[c].alias(c) for c in docs.columns])
    everything = changed.unionByName(rest)
    return everything.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else everything
