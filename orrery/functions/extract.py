"""Imports and symbols of source lines, by one regular expression a language."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.metrics import BLANKS, lines_of, trimmed, trimmed_lines
from orrery.functions.paths import language_of, normalize_path, once, parent_dir
from orrery.session import dealt

#: What a bare import may be called on disk, in order.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".rs", ".py", ".go", ".java", "/mod.rs", "/index.ts", "/index.tsx", "/index.js")
#: Roots that bare imports are tried below, in order.
ROOTS = ("", "src/", "lib/", "src/main/java/", "src/test/java/", "app/src/main/java/", "lib/src/main/java/")

TS_FROM = r"""\sfrom\s+["']([^"']+)["']"""
TS_BARE = r"""^import\s+(?:type\s+)?["']([^"']+)["']"""
TS_CALL = r"""import\(\s*["']([^"']+)["']"""
RUST_USE, RUST_MOD = r"^use\s+([^;{]+?)(?:\s+as\s.*)?\s*(?:[;{].*)?$", r"^mod\s+([A-Za-z0-9_]+)"
PY_IMPORT, PY_FROM = r"^import\s+([^\s,]+)", r"^from\s+(\S+)"
JAVA_STATIC, JAVA_IMPORT = r"^import\s+static\s+([\w.]+?)\.\w+\s*;?$", r"^import\s+(?!static\s)([\w.]*\w)\s*;?$"

#: Symbol declarations: group 1 is the keyword, group 2 the name.
TS_SYMBOL = r"^(?:export )?(?:async )?(function|class|interface|type|const|let|var) ([\p{L}\p{N}_]+)"
RUST_SYMBOL = r"^(?:pub )?(?:async )?(fn|struct|enum|trait|type|const) ([\p{L}\p{N}_]+)"
PY_SYMBOL = r"^(class|def) ([\p{L}\p{N}_]+)"
JAVA_SYMBOL = r"^(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed) )*(class|interface|enum|record|void) ([\p{L}\p{N}_]+)"
#: The kinds that keywords stand for.
KINDS = {"fn": "function", "def": "function", "void": "function", "let": "variable", "var": "variable", "record": "class"}


def _all(line: Column, rule: str) -> Column:
    return F.regexp_extract_all(line, F.lit(rule), F.lit(1))


def imports_of(line: Column, language: Column) -> Column:
    """Import names of one trimmed line; dots of Python and Java names become slashes."""
    slashed = lambda names: F.transform(names, lambda n: F.replace(n, F.lit("."), F.lit("/")))
    ts = F.concat(_all(F.concat(F.lit(" "), line), TS_FROM), _all(line, TS_BARE), _all(line, TS_CALL))
    ts = F.when(F.contains(line, F.lit("from")) | F.contains(line, F.lit("import")), ts).otherwise(F.array().cast("array<string>"))
    rust = F.transform(F.concat(_all(line, RUST_USE), _all(line, RUST_MOD)), lambda n: F.trim(n))
    python = F.filter(slashed(F.concat(_all(line, PY_IMPORT), _all(line, PY_FROM))), lambda n: n != "/")
    java = slashed(F.concat(_all(line, JAVA_STATIC), _all(line, JAVA_IMPORT)))
    return F.when(language == "rust", rust).when(language == "python", python).when(language == "java", java).otherwise(ts)


def _texts_where(files: DataFrame, kept: Sequence[str], test: Callable[[Column, Column], Column]) -> DataFrame:
    """``files`` with their language, as far as ``test(content, language)`` holds."""
    fit = files.where(once(language_of(F.col("path")), lambda language: test(F.col("content"), language)))
    return fit.select(*kept, language_of(F.col("path")).alias("language"), "content")


def _may_import(text: Column, language: Column) -> Column:
    """Whether a line, or any line of a text, holds a word that every import of the language has."""
    either = lambda a, b: F.contains(text, F.lit(a)) | F.contains(text, F.lit(b))
    return F.when(language == "rust", either("use", "mod")).otherwise(either("import", "from"))


def extract_imports(files: DataFrame) -> DataFrame:
    """``(path, spec)`` of ``files(path, content)``, distinct; a ``package`` of the files stays with them."""
    kept = [c for c in ("path", "package") if c in files.columns]
    texts = _texts_where(files, kept, _may_import)
    lines = texts.select(*kept, "language", F.explode(lines_of(F.col("content"))).alias("line")).where(_may_import(F.col("line"), F.col("language")))
    found = lines.withColumn("line", trimmed(F.col("line"))).select(*kept, F.explode(imports_of(F.col("line"), F.col("language"))).alias("spec"))
    return found.where("spec <> ''").distinct()


def bases(path: Column, spec: Column, package: Column) -> Column:
    """Paths that an import may mean, without what ``SUFFIXES`` add, best first."""
    return bases_in(parent_dir(path), spec, package)


def bases_in(here: Column, spec: Column, package: Column) -> Column:
    """``bases`` of an import by any file of the folder ``here``."""
    above = parent_dir(here)
    tail = lambda head: F.replace(F.regexp_replace(spec, f"^{head}(::)?", ""), F.lit("::"), F.lit("/"))
    in_source = lambda root, name: F.when(root == ".", F.concat(F.lit("src/"), name)).otherwise(F.concat(root, F.lit("/"), name))
    relative = F.when(F.startswith(spec, F.lit(".")), normalize_path(F.concat(here, F.lit("/"), spec)))
    own = F.when(F.startswith(spec, F.lit("self::")), in_source(here, tail("self")))
    package_src = F.when(package == ".", F.lit("src")).otherwise(F.concat(package, F.lit("/src")))
    crate = F.when(F.regexp_like(spec, F.lit("^crate(::|$)")), F.concat(package_src, F.lit("/"), tail("crate")))
    outer = F.when(F.regexp_like(spec, F.lit("^super(::|$)")), F.when(tail("super") == "", F.when(above == ".", here).otherwise(above)).otherwise(in_source(above, tail("super"))))
    slashed = F.replace(spec, F.lit("\\"), F.lit("/"))
    found = F.array_compact(F.array(relative, own, crate, outer, *[F.concat(F.lit(r), slashed) for r in ROOTS]))
    return F.transform(found, lambda b: F.regexp_replace(b, "/+$", ""))


def candidates(path: Column, spec: Column, package: Column) -> Column:
    """Paths that an import may mean, best first."""
    endings = F.array(*map(F.lit, SUFFIXES))
    return F.flatten(F.transform(bases(path, spec, package), lambda b: F.transform(endings, lambda e: F.concat(b, e))))


def stems(files: DataFrame) -> DataFrame:
    """``(target, suffix, base)``: what stands before each of ``SUFFIXES``, by its number, that ``files(target)`` end with."""
    target = F.col("target")
    ends = [F.when(F.endswith(target, F.lit(e)), F.struct(F.lit(k).alias("suffix"), F.left(target, F.length(target) - len(e)).alias("base"))) for k, e in enumerate(SUFFIXES)]
    return files.select("target", F.explode(F.array_compact(F.array(*ends))).alias("s")).select("target", "s.*")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``(source, target)`` file edges of ``imports(path, spec)`` over ``files(path, package)``; paths are distinct.

    The first candidate that is a file wins; imports of none of them match the smallest path
    that ends in the import as a Java path.  Both steps are equi-joins on exploded names.

    What an import means depends on the folder and the package of its file, so equal imports of
    a folder are looked up once and only the answers meet the files.  Imports that bring the
    ``package`` of their file (``extract_imports`` of the same files) need not look for it.
    """
    if "package" in imports.columns:
        owned = imports.withColumn("inside", F.lit(True))
    else:
        owned = imports.join(files.select("path", "package", F.lit(True).alias("inside")), "path", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    owned = owned.select("path", "spec", "package", "inside", parent_dir(F.col("path")).alias("here"))
    keys = ["inside", "here", "package", "spec"]
    asked = owned.select(*keys).distinct()

    def answered(left: DataFrame, right: DataFrame) -> DataFrame:
        named = right.select(*[F.col(c).alias(f"__{c}") for c in keys], "target")
        same = [F.col(c) == F.col(f"__{c}") for c in keys if c != "package"] + [F.col("package").eqNullSafe(F.col("__package"))]
        return left.join(named, same, "left").drop(*[f"__{c}" for c in keys])

    # A file has two or three suffixes; an import with all its suffixes would be thirteen times the rows.
    tried = asked.where("inside").select(*keys, F.posexplode(bases_in(F.col("here"), F.col("spec"), F.col("package"))).alias("ord", "base"))
    known = files.select(F.col("path").alias("target")).distinct()
    # Spark takes exploded paths for few and would broadcast them.
    direct = tried.join(dealt(stems(known)), "base").groupBy(*keys).agg(F.min_by("target", F.struct("ord", "suffix")).alias("target"))
    met = answered(asked, direct).withColumn("suffix", F.when(F.col("target").isNull(), F.concat(F.regexp_replace(F.replace("spec", F.lit("\\"), F.lit("/")), "^/+", ""), F.lit(".java"))))
    parts = F.split("target", "/")
    tails = known.where(F.endswith("target", F.lit(".java"))).select(
        "target", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix")
    )
    met = met.join(tails.groupBy("suffix").agg(F.min("target").alias("tail")), "suffix", "left").select(*keys, F.coalesce("target", "tail").alias("target"))
    edges = answered(owned, met.where("target IS NOT NULL"))
    return edges.where("path <> target").select(F.col("path").alias("source"), "target").distinct()


def symbol_of(line: Column, language: Column) -> Column:
    """Struct (kind, label) of a declaration on a trimmed line; null otherwise."""
    rule = lambda r: F.struct(F.regexp_extract(line, r, 1).alias("kind"), F.regexp_extract(line, r, 2).alias("label"))
    found = F.when(language == "rust", rule(RUST_SYMBOL)).when(language == "python", rule(PY_SYMBOL)).when(language == "java", rule(JAVA_SYMBOL)).otherwise(rule(TS_SYMBOL))

    def kind(word: Column) -> Column:
        named = F.when(word.isNull(), None)
        for keyword, name in KINDS.items():
            named = named.when(word == keyword, name)
        return named.otherwise(word)

    return once(found, lambda f: F.when(f["label"] != "", F.struct(kind(f["kind"]).alias("kind"), f["label"].alias("label"))))


def _by_language(language: Column, test: Callable[[str], Column]) -> Column:
    return F.when(language == "rust", test(RUST_SYMBOL)).when(language == "python", test(PY_SYMBOL)).when(language == "java", test(JAVA_SYMBOL)).otherwise(test(TS_SYMBOL))


def declares(text: Column, language: Column, times: int = 1) -> Column:
    """Whether at least so many lines of a text are declarations; a line ends at its line feed only."""
    start = lambda r: f"^[{BLANKS.replace(chr(10), '')}]*+(?>{r[1:]})"
    return _by_language(language, lambda r: F.regexp_like(text, F.lit("(?md)" + "(?s:.*?)".join([start(r)] * times))))


def extract_symbols(files: DataFrame) -> DataFrame:
    """``(id, label, kind, file, line)``; ids repeat where a file repeats a name."""
    language = F.col("language")
    texts = _texts_where(files, ["path"], declares)
    lines = texts.select("path", "language", F.posexplode(lines_of(F.col("content"))).alias("at", "line")).select("path", "language", "at", trimmed(F.col("line")).alias("t"))
    found = lines.where(_by_language(language, lambda r: F.regexp_like("t", F.lit(r)))).select("path", "at", symbol_of(F.col("t"), language).alias("s"))
    return found.select(F.concat("path", F.lit("::"), "s.label").alias("id"), "s.label", "s.kind", F.col("path").alias("file"), (F.col("at") + 1).alias("line"))


def symbol_edges(files: DataFrame, max_symbols: int = 128, max_body: int = 400) -> DataFrame:
    """``(source, target)``: a symbol whose body holds another symbol's name; both limits are the definition.

    Symbols and bodies stay in their file's row, so nothing is paired across files.  Only
    files with two declarations are taken apart.
    """
    texts = _texts_where(files, ["path"], lambda text, language: declares(text, language, 2))
    body = texts.select("path", "language", trimmed_lines(F.col("content")).alias("ls"))
    marked = F.transform("ls", lambda t, i: F.struct(i.alias("at"), symbol_of(t, F.col("language")).alias("s")))
    own = body.withColumn("syms", F.slice(F.filter(marked, lambda x: x["s"].isNotNull()), 1, max_symbols)).where(F.size("syms") > 1)
    each = own.select("path", "ls", "syms", F.posexplode("syms").alias("k", "me"))
    after = F.get("syms", F.col("k") + 1)["at"]
    length = F.least(F.coalesce(after, F.size("ls")) - F.col("me.at"), F.lit(max_body))
    text = each.select("path", "k", F.col("me.s.label").alias("label"), "syms", F.array_join(F.slice("ls", F.col("me.at") + 1, length), "\n").alias("text"))
    uses = F.filter("syms", lambda o, j: (j != F.col("k")) & F.contains(F.col("text"), o["s"]["label"]))
    pairs = text.select("path", "label", F.explode(uses).alias("o")).where("label <> o.s.label")
    name = lambda c: F.concat("path", F.lit("::"), c)
    return pairs.select(name("label").alias("source"), name("o.s.label").alias("target")).distinct()
