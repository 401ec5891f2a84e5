"""P1: files that nobody wrote by hand - tool output, minified or bundled code, lock files, vendored copies, data as code.

Three stages, all inside the JVM and, but for the pairs of the second, linear in the text:

1. per text, token-composition counts (comment banners, literals, identifiers, line lengths) by built-in expressions;
2. an inverted index of the line hashes of all distinct bodies, of all repositories. Only lines that stand in several repositories can
   tell of a copy, so the others leave the index at once. A body that holds a share c of a file's k lines holds at least one of any
   k - ceil(c k) + 1 of them, so the rarest so many lines of a file name every body that can reach the share, and no other lines are
   looked up; each pair so named is counted exactly over the lines of both;
3. composition rules for everything else.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.session import checkpoint, own_columns

# Folders that by convention hold copies of other people's libraries.
VENDOR_DIRS = ("vendor", "_vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "external", "externals", "extern", "node_modules", "bower_components", "jspm_packages", "site-packages", "dist-packages", "godeps", "pods", "carthage")
# Names of lock files.
LOCK_NAMES = ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "cargo.lock", "poetry.lock", "pipfile.lock", "gemfile.lock", "composer.lock", "uv.lock", "bun.lockb", "deno.lock")
# Name endings that code generators use.
GENERATED_NAMES = (
    r"\.pb(\.gw|\.validate)?\.(go|js|ts|cc|h|py|java)", r"_pb2(_grpc)?\.pyi?", r"_pb\.(js|d\.ts|rb)", r"_grpc\.pb\.go", r"\.(g|gen|generated|designer)\.[a-z]{1,5}", r"[._-](generated|gen)\.[a-z]{1,5}",
    r"_(string|enumer|easyjson|ffjson|msgp|deepcopy)(_gen)?\.go",
)
MINIFIED_NAMES = (r"[.-]min\.(js|mjs|css)", r"\.(bundle|prod|chunk|packed)\.(js|mjs|css)")
# Files whose text is configuration, never "data stored as code".
CONFIG_NAMES = r"(\.(json|ya?ml|ini|toml|cfg|conf|properties|xml|md|txt|rst|csv|tsv|lock|env)|(^|/)\.env(\.[\w.]+)?)$"

_OPEN = r'(?:(?://|#|/\*|<!--|--|;|%|"""|\'\'\'|\*)[/!*#\s-]*)'
_TOOL = r"[\w`./@+-]+"
#: A comment line that says a tool made the file. Each needs the tool's role (passive voice, made by ...) and not just the word.
BANNERS = (
    rf"(?:this (?:file|code|module|source) (?:is|was|has been) )?(?:code |source |file )?(?:auto[- ]?|automatically |machine[- ])?generated\b(?: (?:file|code))? (?:by|from|with|using|via)\b.{{0,80}}(?:do not|don'?t|never|not be|changes|edits|modif|overwrit|lost)",
    rf"(?:this (?:file|code|module|source) (?:is|was|has been) )(?:auto(?:matically)?[- ]?|machine[- ])generated\b",
    rf"code generated by {_TOOL}", rf"@generated\b", rf"auto[- ]?generated\b(?: (?:file|code)\b| (?:by|from|with) {_TOOL}|[.:!]|$)", r"</?auto-?generated\b", rf"generated by the {_TOOL} (?:compiler|generator|tool)\b",
    r"(?:warning|attention|note|caution)[:!]? (?:this file is )?(?:machine|auto|tool)[- ]?(?:made|generated|written)\b", rf"output of [`'\"]?{_TOOL}.{{0,60}}(?:regenerate|re-generate|do not edit|instead of editing)", rf"<{_TOOL}-output\b",
    r"(?:automatisch|maschinell) (?:erzeugt|erstellt|generiert)\b.{0,80}(?:nicht|keine)", r"(?:fichier|code) (?:généré|produit)e? (?:automatiquement )?par\b", r"(?:archivo|código|fichero) generado (?:automáticamente )?por\b", r"(?:arquivo|ficheiro|código) gerado (?:automaticamente )?por\b",
    r"(?:file|codice) generato (?:automaticamente )?da\b", r"automatisch gegenereerd\b", r"(?:файл|код) (?:автоматически )?(?:создан|сгенерирован)", r"(?:自动生成|自動生成|由.{1,30}生成)",
    r"(?:do not|don'?t) (?:edit|modify)(?: (?:this file|by hand|manually))?\b.{0,60}\b(?:generated|regenerat|overwritten)",
)
#: A comment line by which a distributed library names itself.
VENDORED = (
    rf"@license\s+{_TOOL}@\d", rf"{_TOOL} v?\d+(?:\.\d+)+ \| \(c\)", r"vendored (?:copy|from)\b", r"copied (?:unchanged|verbatim|unmodified)\b", r"(?:bundled|embedded) third[- ]party\b", r"upstream commit [0-9a-f]{6,40}\b.{0,40}(?:none|unchanged|unmodified)",
)


def _line_rx(patterns: tuple[str, ...]) -> str:
    return rf"(?imu)^[ \t]*{_OPEN}\s*(?:{'|'.join(patterns)})"


def _composition(text: Column, config: Column) -> dict[str, Column]:
    """Counts over one text. The expensive ones are only evaluated for texts that can meet their rule."""
    n = F.length(text)
    lines = F.size(F.array_remove(F.transform(F.split(text, "\r\n|\r|\n"), F.trim), ""))
    dense = n > 120 * F.greatest(lines, F.lit(1))
    bare = F.regexp_replace(text, r"\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`", " ")
    code_only = F.regexp_replace(text, r"(?m)^[ \t]*(?://|#|/\*|\*|\"\"\"|package\b|import\b|from\b|[\"']use strict).*$", "")
    rest = F.regexp_replace(F.regexp_replace(code_only, r"\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`", " "), r"\b(?:0[xX][0-9a-fA-F]+|[0-9][\w.]*)|\b(?:true|false|null|None|nil|True|False)\b|[^\p{L}\p{N}_$]+", " ")
    # A text whose first code character run is a declaration and that has few lines starting with a word, is worth a closer look.
    may_be_data = ~config & (n >= 256) & text.rlike(r"[=(]\s*(?:\[\]\s*\w+\s*)?[\[{(\"'`]|export default")
    return {
        "n_chars": n.cast("long"), "n_lines": lines.cast("long"), "n_space": (n - F.length(F.translate(text, " \t\r\n", ""))).cast("long"),
        "n_ids": F.when(dense, F.regexp_count(bare, F.lit(r"[A-Za-z_$][\w$]*"))).otherwise(0).cast("long"), "n_short": F.when(dense, F.regexp_count(bare, F.lit(r"(?<![\w$])[A-Za-z_$][\w$]?(?![\w$])"))).otherwise(0).cast("long"),
        "n_rest": F.when(may_be_data, F.length(F.trim(rest))).otherwise(n).cast("long"), "n_words": F.when(may_be_data, F.size(F.array_remove(F.split(F.trim(rest), " +"), ""))).otherwise(10_000).cast("long"), "n_code": F.when(may_be_data, F.length(F.trim(code_only))).otherwise(0).cast("long"),
        "banner": F.when(text.rlike(_line_rx(BANNERS)), 1).otherwise(0), "library": F.when(text.rlike(_line_rx(VENDORED)), 1).otherwise(0), "locked": F.when(text.contains('"lockfileVersion"') | text.rlike(r"(?m)^# (?:yarn lockfile|This file is automatically @generated by Cargo)"), 1).otherwise(0),
    }


def _any_name(path: Column, patterns: tuple[str, ...]) -> Column:
    return F.lower(path).rlike(rf"(?:{'|'.join(patterns)})$")


def find_generated(nodes: DataFrame, symbols: DataFrame, containment: float = 0.9, min_lines: int = 8, spread: int = 3) -> DataFrame:
    """One row per row of ``nodes`` whose file nobody wrote by hand: node_key, node_id, origin, evidence, containment.

    ``origin`` is one of lock, minified, vendored, generated, data (the first that holds, in that order). A file with at least
    ``containment`` of its lines (``min_lines`` or more) in a file of another repository is a copy if that one is a library's, if it is
    older by its modified_at, or if that one stands in ``spread`` repositories or more; the repository with the oldest one has it by right, and of two files of unknown age in two
    repositories neither is called the copy. ``nodes`` may lack modified_at.

    Nulls: a row with null node_id is judged by its code alone. A null code is replaced by the file's symbols, whose
    counts are summed per file (never concatenated). With neither, names alone decide. Empty texts are no case unless their
    name says so. Repeated node_id rows count each. An empty table gives an empty result; extra columns are ignored.
    """
    dated = "modified_at" in nodes.columns
    nodes = own_columns(nodes, "node_key", "node_id", "code", *(["modified_at"] if dated else [])).withColumn("at", F.col("modified_at").cast("string") if dated else F.lit(None).cast("string"))
    symbols = own_columns(symbols, "symbol_id", "symbol_content")
    path = F.coalesce("node_id", F.lit(""))
    config = F.lower(path).rlike(CONFIG_NAMES)
    names = ["n_chars", "n_lines", "n_space", "n_ids", "n_short", "n_rest", "n_words", "n_code", "banner", "library", "locked"]

    own = _composition(F.col("code"), config)
    # Rows of one file may have different texts; each text is judged for itself.
    version = F.xxhash64("code").alias("version")
    with_code = nodes.where("code is not null").select("node_key", "node_id", "at", version, *(own[c].alias(c) for c in names))
    bare = nodes.where("code is null").select("node_key", "node_id", "at", version)

    # Files without code: counts of their symbols, partially aggregated before the shuffle by file.
    file_id = F.substring_index("symbol_id", ":", 1)
    per = _composition(F.col("symbol_content"), F.lower(file_id).rlike(CONFIG_NAMES))
    wanted = bare.where("node_id is not null").select("node_id").distinct()
    of_symbols = (
        symbols.where("symbol_id is not null and symbol_content is not null").withColumn("node_id", file_id).join(wanted, "node_id", "left_semi")
        .groupBy("node_id").agg(*(F.sum(per[c]).alias(c) if c.startswith("n_") else F.max(per[c]).alias(c) for c in names))
    )
    from_symbols = bare.join(of_symbols, "node_id", "left").select("node_key", "node_id", "at", "version", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))
    counts = with_code.unionByName(from_symbols)

    folder = F.lower(path).rlike(rf"(?:^|/)(?:{'|'.join(d.replace('.', '[.]') for d in VENDOR_DIRS)})/")
    lines = F.greatest("n_lines", F.lit(1))
    minified = (F.col("n_chars") >= 200) & (F.col("n_chars") > 150 * lines) & (F.col("n_space") < 0.1 * F.col("n_chars")) & (F.col("n_ids") >= 20) & (F.col("n_short") >= 0.45 * F.col("n_ids"))
    data = ~config & (F.col("n_code") >= 256) & (F.col("n_words") <= 6) & (F.col("n_rest") <= 0.2 * F.col("n_code"))
    lock = F.lower(F.substring_index(path, "/", -1)).isin(*LOCK_NAMES) | (F.col("locked") == 1)
    generated_name = _any_name(path, GENERATED_NAMES) | F.lower(path).rlike(r"(?:^|/)(?:zz_generated[._]|moc_|ui_|mock_)[^/]*(?:generated|_gen)?\.[a-z]+$") & F.lower(path).rlike(r"(?:^|/)(?:zz_generated|moc_|mock_[^/]*_(?:generated|gen)\.)")
    origin = F.when(lock, "lock").when(minified | _any_name(path, MINIFIED_NAMES), "minified").when(folder | (F.col("library") == 1), "vendored").when(generated_name | (F.col("banner") == 1), "generated").when(data, "data")
    evidence = F.when(lock, "name or content of a lock file").when(minified, "dense lines of short names").when(_any_name(path, MINIFIED_NAMES), "name").when(folder, "folder").when(F.col("library") == 1, "library notice").when(generated_name, "name").when(F.col("banner") == 1, "banner").when(data, "one literal")
    # Three later stages read the judgements; the texts are scanned for them once.
    judged = checkpoint(counts.select("node_key", "node_id", "version", "at", origin.alias("origin"), evidence.alias("evidence")))

    copies = vendored_copies(nodes, symbols, judged, containment, min_lines, spread).withColumnRenamed("evidence", "told")
    return (
        judged.join(copies.withColumnRenamed("fid", "node_id"), ["node_id", "version"], "left")
        .select("node_key", "node_id", F.coalesce("origin", F.when(F.col("contained").isNotNull(), "vendored")).alias("origin"), F.coalesce("evidence", "told").alias("evidence"), F.col("contained").alias("containment"))
        .where("origin is not null")
    )


def line_index(nodes: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """fid, version, repo, body, k, hs: the distinct informative lines of every text of a file, as 64-bit hashes, each text once.

    Lines of under 12 characters or without a letter tell nothing of where a file comes from. Comment lines are left out, so a
    notice that was put on top of a copy does not matter. A file without code has the lines of its symbols. ``body`` stands for
    the set of lines, in whatever order.
    """

    def hashes(text: str) -> Column:
        lines = F.filter(F.transform(F.split(text, "\r\n|\r|\n"), F.trim), lambda x: (F.length(x) >= 12) & x.rlike(r"\p{L}") & ~x.rlike(r"^(?://|#|/\*|\*|\"\"\"|''')"))
        return F.transform(F.array_distinct(lines), lambda x: F.xxhash64(x))

    version = F.xxhash64("code").alias("version")
    named = nodes.where("node_id is not null")
    files = named.where("code is not null").select(F.col("node_id").alias("fid"), version, hashes("code").alias("hs")).groupBy("fid", "version").agg(F.first("hs").alias("hs"))
    if symbols is not None:
        bare = named.where("code is null").select(F.col("node_id").alias("fid"), version).distinct()
        lines = symbols.where("symbol_content is not null").select(F.substring_index("symbol_id", ":", 1).alias("fid"), F.explode(hashes("symbol_content")).alias("h"))
        files = files.unionByName(lines.join(bare, "fid").groupBy("fid", "version").agg(F.collect_set("h").alias("hs")))
    return files.select("fid", "version", F.substring_index("fid", "/", 1).alias("repo"), F.xxhash64(F.array_sort("hs")).alias("body"), F.size("hs").alias("k"), "hs")


def vendored_copies(nodes: DataFrame, symbols: DataFrame, judged: DataFrame, containment: float, min_lines: int, spread: int) -> DataFrame:
    """fid, version, contained, evidence: texts not yet judged that are copies of a file of another repository.

    The index has the bodies (sets of lines) of all files that are not minified, generated, locked or data, each body once.
    """
    origins = (
        judged.where("node_id is not null and (origin is null or origin = 'vendored')").groupBy(F.col("node_id").alias("fid"), "version")
        .agg(F.max(F.col("origin").isNotNull()).alias("known"), F.min("at").alias("at"))
    )
    files = checkpoint(line_index(nodes, symbols).where(F.col("k") >= min_lines).join(origins, ["fid", "version"]))
    bodies = files.groupBy("body").agg(F.first("k").alias("k"), F.first("hs").alias("hs"), F.min("repo").alias("lo"), F.max("repo").alias("hi"), F.min("known").alias("settled"))
    need = F.ceil(containment * F.col("k") - 1e-9)

    # Lines of one repository alone can be in no copy: for the rest of a file they count as missed.
    lines = bodies.select("body", "k", "settled", "lo", "hi", F.explode("hs").alias("h"))
    between = lines.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("h", "df")
    shared = checkpoint(lines.select("body", "k", "settled", "h").join(between, "h"))
    rare = (
        shared.where("not settled").groupBy("body", "k").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("ls"))
        .where(F.size("ls") >= need).select("body", need.alias("need"), F.explode(F.slice("ls", F.lit(1), (F.size("ls") - need + 1).cast("int"))).alias("l")).select("body", "need", "l.h")
    )
    named = rare.join(shared.select("h", F.col("body").alias("other"), F.col("k").alias("size")), "h").where("body <> other and size >= need").select("body", "need", "other").distinct()
    mine, theirs = bodies.select("body", "k", F.col("hs").alias("mine")), bodies.select(F.col("body").alias("other"), F.col("hs").alias("theirs"))
    pairs = named.join(mine, "body").join(theirs, "other").withColumn("both", F.size(F.array_intersect("mine", "theirs"))).where("both >= need").select("body", "other", (F.col("both") / F.col("k")).alias("contained"))
    same = bodies.where("lo <> hi and not settled").select("body", F.col("body").alias("other"), F.lit(1.0).alias("contained"))
    pairs = checkpoint(pairs.unionByName(same))

    # What a file must know of the other body, whatever the number of its repositories: between which names those lie that have it as a
    # library, the oldest file, and in how many repositories it stands. The repository with the oldest one has it by right.
    concerned = pairs.select(F.explode(F.array("body", "other")).alias("body")).distinct()
    owners = files.join(concerned, "body", "left_semi").groupBy("body", "repo").agg(F.max("known").alias("known"), F.min("at").alias("at"))
    library = F.when(F.col("known"), F.col("repo"))
    about = owners.groupBy(F.col("body").alias("other")).agg(F.min(library).alias("from"), F.max(library).alias("to"), F.min(F.when(F.col("at").isNotNull(), F.struct("at", "repo"))).alias("one"), F.count(F.lit(1)).alias("n"))
    elsewhere = F.coalesce(F.col("one.repo") != F.col("repo"), F.lit(True))
    told = (
        F.when((F.col("from") != F.col("repo")) | (F.col("to") != F.col("repo")), "copy of a library file elsewhere")
        .when(elsewhere & (F.col("one.at") < F.col("at")), "copy of an older file of another repository").when(elsewhere & (F.col("n") >= spread), "copy in several repositories")
    )
    # A file is as old as the first one of its lines in its repository.
    aged = files.where("not known").select("fid", "version", "repo", "body").join(owners.select("body", "repo", "at"), ["body", "repo"])
    rows = aged.join(pairs, "body").join(about, "other").select("fid", "version", "contained", told.alias("evidence")).where("evidence is not null")
    return rows.groupBy("fid", "version").agg(F.max("contained").alias("contained"), F.min("evidence").alias("evidence"))
