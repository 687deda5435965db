"""The code graph: symbols and relations out of source texts, and resolving references among them.

What single lines show is found by expressions inside the JVM; what needs a parser or offsets runs as one
Arrow batch function over files.  Files are independent, so extraction scales with the number of files.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import BLANK, edged, normal_path, resolve_module, shared_segments

FOUND = T.StructType([T.StructField(n, t) for n, t in (("path", T.StringType()), ("part", T.StringType()), ("kind", T.StringType()), ("name", T.StringType()), ("parent", T.StringType()), ("target", T.StringType()), ("line", T.IntegerType()), ("line_end", T.IntegerType()), ("exported", T.BooleanType()), ("confidence", T.DoubleType()), ("source", T.StringType()))])


def lines_of(files: DataFrame, text: str = "text") -> DataFrame:
    """`path, line, value`: the lines of each file, from 1."""
    return files.select("path", F.posexplode(F.split(text, "\n")).alias("line", "value")).withColumn("line", F.col("line") + 1)


def line_symbols(files: DataFrame) -> DataFrame:
    """`id, path, name, line, lang, exported` of functions that a single line declares (JavaScript and Python forms)."""
    rows = lines_of(files)
    js = F.regexp_extract("value", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\(", 1)
    py = F.regexp_extract("value", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(", 1)
    name = F.when(js != "", js).when(py != "", py)
    out = rows.select("path", name.alias("name"), "line", F.when(js != "", "js").otherwise("py").alias("lang"), F.when(js != "", F.col("value").rlike(r"^\s*export\s")).otherwise(~F.startswith(py, F.lit("_"))).alias("exported")).where("name is not null")
    return out.withColumn("id", F.concat_ws("::", "path", "name"))


def spans(symbols: DataFrame) -> DataFrame:
    """Symbols with `line_end`: the line before the next one of the file (the last reaches to the end)."""
    nxt = F.lead("line").over(Window.partitionBy("path").orderBy("line"))
    return symbols.withColumn("line_end", F.coalesce(nxt - 1, F.lit(1 << 30)).cast("int"))


def name_map(symbols: DataFrame, order: list[str]) -> DataFrame:
    """`name, id`: the last symbol of each name by `order`."""
    return symbols.groupBy("name").agg(F.max_by("id", F.struct(*order)).alias("id"))


def member_of(symbols: DataFrame) -> DataFrame:
    return symbols.where("parent is not null").select(F.col("id").alias("src"), F.col("parent").alias("dst"), F.lit("MEMBER_OF").alias("kind"))


def symbol_id(path: Column, name: Column, parent: Column) -> Column:
    return F.concat(path, F.lit("::"), F.when(parent.isNotNull(), F.concat(parent, F.lit("."), name)).otherwise(name))


def enclosing(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """`points` (`path, line`) with `inside`: the narrowest symbol around the line, else the path.

    The join is by file, so a partition holds the symbols of its files only.
    """
    s = symbols.select("path", F.col("id").alias("_id"), F.col("line").alias("_a"), F.col("line_end").alias("_b"))
    at = points.select("path", "line").distinct()
    hits = at.join(s, "path").where((F.col("_a") <= F.col("line")) & (F.col("_b") >= F.col("line"))).groupBy("path", "line").agg(F.min_by("_id", F.struct(F.col("_b") - F.col("_a"), "_id")).alias("_in"))
    return points.join(hits, ["path", "line"], "left").select(*[points[c] for c in points.columns], F.coalesce("_in", points["path"]).alias("inside"))


def touched(symbols: DataFrame, changes: DataFrame) -> DataFrame:
    """Symbols whose lines meet a changed line (`path, line`)."""
    ch = changes.select("path", F.col("line").alias("_l"))
    return symbols.join(ch, (symbols["path"] == ch["path"]) & (symbols["line"] <= F.col("_l")) & (symbols["line_end"] >= F.col("_l")), "left_semi")


def candidate_scores(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References (`ref_id, name, path, line, lang, kind`) with each symbol of their name and its `points`."""
    s = symbols.select("name", F.col("id").alias("target"), F.col("path").alias("_p"), F.col("line").alias("_l"), F.col("lang").alias("_g"), F.col("kind").alias("_k"), F.col("exported").alias("_e"))
    j = refs.join(s, "name")
    same = F.col("path") == F.col("_p")
    near = F.when(same, 100 + F.greatest(F.lit(0), 20 - F.floor(F.abs(F.col("line") - F.col("_l")) / 10))).otherwise(F.least(15 * shared_segments(F.col("path"), F.col("_p")), F.lit(80)))
    fits = F.when(F.col("kind") == "calls", F.col("_k").isin("function", "method")).when(F.col("kind") == "instantiates", F.col("_k") == "class").when(F.col("kind") == "extends", F.col("_k").isin("class", "interface")).when(F.col("kind") == "implements", F.col("_k") == "interface").when(F.col("kind") == "imports", F.col("_k").isin("module", "function", "class")).otherwise(F.lit(False))
    points = near + F.when(F.col("lang") == F.col("_g"), 50).otherwise(-80) + F.when(fits, 25).otherwise(0) + F.when(F.col("_e"), 10).otherwise(0)
    return j.select("ref_id", "name", "target", points.cast("int").alias("points"))


def best_candidate(scores: DataFrame) -> DataFrame:
    """`ref_id, target, confidence, ambiguous, others`: the best symbol of each reference, and up to four within ten points of it."""
    top = scores.groupBy("ref_id").agg(F.max("points").alias("_top"))
    near = scores.join(top, "ref_id").where(F.col("points") >= F.col("_top") - 10)
    ranked = near.withColumn("_n", F.row_number().over(Window.partitionBy("ref_id").orderBy(F.col("points").desc(), "target"))).where("_n <= 5")
    out = ranked.groupBy("ref_id").agg(F.min_by("target", "_n").alias("target"), F.first("_top").alias("_top"), F.transform(F.array_sort(F.collect_list(F.struct("_n", "target"))), lambda x: x["target"]).alias("_all"))
    return out.select("ref_id", "target", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_top") / 200)).alias("confidence"), (F.size("_all") > 1).alias("ambiguous"), F.slice("_all", 2, 4).alias("others"))


# Endings that an import path may leave out, in the order in which they are tried.
ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", ".java", "/index.ts", "/index.js", "/index.tsx", "/index.jsx", "/index.mjs"]


def import_targets(refs: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """`ref_id, target`: references whose name their file imports from a relative module (`path, name, module`), found in that module's file, else below its path."""
    want = refs.join(imports, ["path", "name"]).withColumn("_base", resolve_module(F.col("path"), F.col("module"))).where("_base is not null")
    s = symbols.select("name", F.col("id").alias("target"), F.col("path").alias("_file"))
    j = want.join(s, "name").where(F.startswith("_file", F.col("_base")))
    order = F.array_position(F.array(*[F.lit(e) for e in ENDINGS]), F.substr("_file", F.length("_base") + 1))
    return j.groupBy("ref_id").agg(F.min_by("target", F.struct(F.when(order > 0, order).otherwise(99), "target")).alias("target"))


def cascade(framework: DataFrame, imported: DataFrame, named: DataFrame) -> DataFrame:
    """`ref_id, target, confidence, resolved_by`: the first of the three strategies (`ref_id, target, confidence`) that is sure (0.9 or more), else the most confident, the earlier one if equal."""
    sure = F.col("confidence") >= 0.9
    parts = [df.select("ref_id", "target", "confidence", F.lit(i).alias("_s")) for i, df in enumerate((framework, imported, named))]
    best = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("ref_id").agg(F.max_by(F.struct("target", "confidence", "_s"), F.struct(sure, F.when(~sure, F.col("confidence")).otherwise(0.0), -F.col("_s"))).alias("b"))
    return best.select("ref_id", "b.target", "b.confidence", F.element_at(F.array(*map(F.lit, ("framework", "import", "name"))), F.col("b._s") + 1).alias("resolved_by"))


# Receivers that are never symbols of the project.
BUILTIN_RECEIVERS = (
    "Set Map WeakSet WeakMap Array Object JSON Math Promise Date String Number Boolean RegExp Error Symbol Reflect Proxy BigInt Intl globalThis console process Buffer URL URLSearchParams document window navigator "
    "localStorage sessionStorage os sys json re time datetime math random logging subprocess shutil pathlib collections itertools functools typing dict list tuple str int float bytes System Objects Arrays "
    "Collections Optional Files Paths Integer Long Double Character StringBuilder LocalDate"
).split()
# Member names that alone are no evidence.
GENERIC_MEMBERS = (
    "add get set has delete clear size push pop shift unshift splice slice concat join keys values entries indexOf lastIndexOf includes map filter reduce forEach find findIndex some every sort reverse flat flatMap "
    "fill then catch finally all race resolve reject log warn info debug trace toString valueOf toJSON hasOwnProperty trim split replace replaceAll match matchAll test exec padStart padEnd startsWith endsWith repeat "
    "toLowerCase toUpperCase charAt charCodeAt substring substr call apply bind append extend items update copy setdefault format lower upper strip lstrip rstrip rsplit splitlines encode decode count insert remove "
    "index put putAll isEmpty contains containsKey containsValue equals hashCode stream collect iterator addAll toArray println printf"
).split()


def trusted_member_call(receiver: Column, method: Column, target: Column, path: Column) -> Column:
    """Whether `receiver.method()` may be taken for the symbol `target` (`file::Parent.name`)."""
    root = F.trim(F.split(receiver, r"[.\[(]")[0])
    file, qualified = F.split(target, "::")[0], F.coalesce(F.try_element_at(F.split(target, "::"), F.lit(2)), F.lit(""))
    owner = F.lower(F.when(F.contains(qualified, F.lit(".")), F.split(qualified, r"\.")[0]).otherwise(F.lit("")))
    r = F.lower(root)
    own = (owner != "") & ((r == owner) | F.endswith(owner, r) | F.endswith(r, owner))
    mine = receiver.rlike(r"^(this|self)(\.|$)")
    return ~root.isin(BUILTIN_RECEIVERS) & (~method.isin(GENERIC_MEMBERS) | (file == path) | mine | own)


# Folders whose files a framework calls into, and the methods it calls there.
BOUND_FOLDERS = r"(?i)/(middleware|commands?|jobs?|handlers?|listeners?|tasks?|observers?|events?|hooks?|subscribers?)/"
BOUND_METHODS = ["handle", "run", "execute", "process", "dispatch", "invoke", "perform", "fire", "trigger", "exec", "call", "__invoke"]


def framework_bound(path: Column, name: Column, parent: Column, kind: Column) -> Column:
    """Whether a framework calls a symbol by convention, so that having no callers says nothing: usual names in its folders, and methods of controllers."""
    controller = (kind == "method") & (F.coalesce(F.endswith(parent, F.lit("Controller")), F.lit(False)) | path.rlike(r"(?i)/controllers?/"))
    return (path.rlike(BOUND_FOLDERS) & name.isin(BOUND_METHODS)) | controller


def is_public(exported: Column, bound: Column, kind: Column, parent: Column) -> Column:
    return exported | bound | ((kind == "method") & parent.isNotNull())


# What each framework's source shows: framework, pattern, how its groups name the target, kind and confidence of the edge,
# kinds of symbols that can be the target (any if empty), and whether the edge starts at the file or at the symbol around the line.
# Names: 'name' the group; 'last' its part behind the last dot; 'first' its part before the first dot; 'member' owner and name; 'action' a controller's base
# name and its method; 'controller' the base name of a controller; 'tag' in Pascal case, else as it is; 'view' the file of a view; 'here' a name in the same file.
FRAMEWORKS = [
    ("express", r"\b(?:app|router)\.(?:get|post|put|patch|delete|all|use)\s*\(\s*['\"][^'\"]+['\"]\s*,\s*([A-Za-z_$][\w$]*)\s*\)", "name", "CALLS", 0.85, "function method", "symbol"),
    ("laravel", r"\[\s*([A-Z][a-zA-Z]+Controller)\s*::\s*class\s*,\s*['\"](\w+)['\"]\s*\]", "member", "CALLS", 0.88, "", "file"),
    ("laravel", r"\b([A-Z][a-zA-Z]+)::(\w+)\s*\(", "member", "CALLS", 0.85, "", "file"),
    ("laravel", r"\broute\s*\(\s*['\"]([\w.-]+)['\"]", "last", "CALLS", 0.65, "method function", "file"),
    ("laravel", r"\bview\s*\(\s*['\"]([\w.-]+)['\"]", "view", "RENDERS", 0.85, "component", "file"),
    ("nestjs", r"@Inject\s*\(\s*([A-Z_][\w_]*)\s*\)", "name", "CALLS", 0.88, "", "symbol"),
    ("react", r"<([A-Z][A-Za-z0-9_]*)\b", "name", "RENDERS", 0.92, "function class component", "symbol"),
    ("react", r"\b(use[A-Z][A-Za-z0-9_]*)\s*\(", "name", "CALLS", 0.88, "function method", "symbol"),
    ("vue", r"<([A-Z][A-Za-z0-9_]*|[a-z]+(?:-[a-z]+)+)\b", "tag", "RENDERS", 0.9, "component function", "symbol"),
    ("vue", r"\b(use[A-Z][A-Za-z0-9_]*)\s*\(", "name", "CALLS", 0.85, "function method", "symbol"),
    ("django", r"\b(?:path|re_path)\s*\(\s*[r]?['\"][^'\"]+['\"]\s*,\s*([A-Za-z_][\w.]*)\b", "last", "CALLS", 0.88, "function class method", "file"),
    ("django", r"@(?:app|bp|blueprint)\.route\s*\([^)]*\)[^\n]*\n(?:[^\n]*\n)?\s*def\s+([a-zA-Z_]\w*)", "here", "CALLS", 0.9, "function", "file"),
    ("django", r"@(?:app|router)\.(?:get|post|put|patch|delete|options|head)\s*\([^)]*\)[^\n]*\n(?:[^\n]*\n)?\s*(?:async\s+)?def\s+([a-zA-Z_]\w*)", "here", "CALLS", 0.9, "function", "file"),
    ("rails", r"\b(?:get|post|put|patch|delete)\s+['\"][^'\"]+['\"]\s*=>\s*['\"](\w+)#(\w+)['\"]", "action", "CALLS", 0.88, "", "file"),
    ("rails", r"\b(?:before_action|after_action|around_action)\s*:(\w+)", "name", "CALLS", 0.8, "method function", "symbol"),
    ("rails", r"\bresources?\s+:(\w+)", "controller", "CALLS", 0.85, "class", "file"),
    ("rails", r"\b([A-Z][a-zA-Z]+)\.find_by_(\w+)", "name", "CALLS", 0.7, "class", "symbol"),
    ("svelte", r"<([A-Z][A-Za-z0-9_]*)\b", "name", "RENDERS", 0.9, "component function", "symbol"),
    ("svelte", r"\{[^}]*?\b([a-zA-Z_$][\w$]*)\s*\(", "name", "CALLS", 0.85, "function method", "symbol"),
    ("shopify", r"\{%[-]?\s*(?:render|include|section)\s+['\"]([\w\-./]+)['\"]", "first", "RENDERS", 0.92, "", "symbol"),
]
# Classes of the framework itself, and words that only look like calls.
FACADES = ["Auth", "Cache", "DB", "Log", "Mail", "Queue", "Session", "Storage", "Validator", "Hash", "Crypt", "Config", "Route", "Schema", "Artisan", "Bus", "Event", "Notification"]
NO_CALLS = ["if", "each", "await", "then", "catch", "snippet", "$state", "$derived", "$effect", "$props", "$bindable", "$inspect", "$host"]
_ADDED: list[tuple] = []


def register_framework(name: str, pattern: str, names: str = "name", kind: str = "CALLS", confidence: float = 0.85, kinds: str = "", start: str = "symbol") -> None:
    """Adds a rule of one's own to those of FRAMEWORKS, in the same form."""
    re.compile(pattern)
    _ADDED.append((name, pattern, names, kind, confidence, kinds, start))


def _capital(name: str) -> str:
    return name[:1].upper() + name[1:]


def _target(form: str, m: re.Match) -> tuple[str | None, str | None, str | None]:
    """Name, owner and second choice (another name, or a file) of what a match points to."""
    a = m.group(1)
    if form in ("member", "action"):
        return m.group(2), a if form == "member" else _capital(a) + "Controller", None
    if form == "tag":
        return "".join(map(_capital, a.split("-"))), None, a if "-" in a else None
    if form == "view":
        return None, None, f"resources/views/{a.replace('.', '/')}.blade.php"
    return {"last": a.rsplit(".", 1)[-1], "first": a.split(".", 1)[0], "controller": _capital(a) + "Controller"}.get(form, a), None, None


def _batches(files: DataFrame, rows_of) -> DataFrame:
    """Runs `rows_of(path, text, lang)` over all files; a file that can't be read gives a row of part 'error'."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text, lang in zip(batch["path"], batch["text"], batch["lang"]):
                try:
                    rows += rows_of(path, text or "", lang)
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append(_row(path, "error", type(e).__name__, None))
            yield pd.DataFrame(rows, columns=[f.name for f in FOUND])

    return files.select("path", "text", "lang").mapInPandas(run, FOUND)


def _row(path, part, kind, name, parent=None, target=None, line=None, line_end=None, exported=None, confidence=None, source=None):
    return (path, part, kind, name, parent, target, line, line_end, exported, confidence, source)


def framework_matches(files: DataFrame, frameworks: list[str]) -> DataFrame:
    """What the frameworks' patterns find: `path, kind, name` (of the target), `parent` (its owner), `target` (second choice), `line, confidence, source`, once for each name and line of a file and pattern.

    `source` is the framework, the form of the name, the kinds of the target and the start of the edge, between bars.
    """
    rules = [(re.compile(r[1]), r[0], *r[2:]) for r in [*FRAMEWORKS, *_ADDED] if r[0] in frameworks]

    def scan(path, text, lang):
        rows, seen = [], set()
        for i, (pattern, source, form, kind, confidence, kinds, start) in enumerate(rules):
            for m in pattern.finditer(text):
                name, owner, second = _target(form, m)
                line = text.count("\n", 0, m.start()) + 1
                if (source == "laravel" and owner in FACADES) or (source == "svelte" and name in NO_CALLS) or (i, name, owner, second, line) in seen:
                    continue
                seen.add((i, name, owner, second, line))
                rows.append(_row(path, "match", kind, name, owner, second, line, line, None, confidence, "|".join((source, form, kinds, start))))
        return rows

    return _batches(files, scan)


def framework_edges(matches: DataFrame, symbols: DataFrame) -> DataFrame:
    """`src, dst, kind, line, confidence, resolved_by`: matches that a symbol (`id, name, path, kind, parent, line, line_end`) answers to, by name (and owner), else by the second choice.

    An edge starts at the file, or at the symbol around the line, and never ends where it starts.
    """
    part = lambda n: F.split("source", r"\|")[n]
    one = ["path", "kind", "line", "confidence", "source", "name", "parent", "target"]
    m = matches.select(*one).distinct().withColumns({"_form": part(1), "_kinds": F.split(part(2), " "), "_start": part(3)})
    m = m.withColumn("_k", F.when(F.col("_form") == "view", F.array(F.struct(F.lit(0).alias("o"), F.col("target").alias("k")))).otherwise(F.array_compact(F.array(F.struct(F.lit(0).alias("o"), F.col("name").alias("k")), F.when(F.col("target").isNotNull(), F.struct(F.lit(1).alias("o"), F.col("target").alias("k")))))))
    m = m.select("*", F.explode("_k").alias("x")).select("*", F.col("x.o").alias("_o"), F.col("x.k").alias("_key")).drop("x", "_k")
    s = symbols.select(F.explode(F.array("name", F.concat(F.lit("file:"), "path"))).alias("_key"), F.col("id").alias("dst"), F.col("parent").alias("_owner"), F.col("kind").alias("_kind"), F.col("path").alias("_file"))
    j = m.withColumn("_key", F.when(F.col("_form") == "view", F.concat(F.lit("file:"), "_key")).otherwise(F.col("_key"))).join(s, "_key")
    fits = (part(2) == "") | F.array_contains("_kinds", F.col("_kind"))
    j = j.where((F.col("parent").isNull() | F.col("_owner").eqNullSafe(F.col("parent"))) & fits & ((F.col("_form") != "here") | (F.col("_file") == F.col("path"))))
    # rows without owner or second choice are told apart by null-safe grouping
    one = j.groupBy(*one, "_start").agg(F.min_by("dst", F.struct("_o", "dst")).alias("dst"))
    around = symbols.where(F.col("kind").isin("function", "method", "class", "component"))
    src = F.when(F.col("_start") == "file", F.col("path")).otherwise(F.col("inside"))
    return enclosing(one, around).select(src.alias("src"), "dst", "kind", "line", "confidence", F.concat(F.lit("framework:"), part(0)).alias("resolved_by")).where("src <> dst").distinct()


def framework_counts(edges: DataFrame) -> DataFrame:
    """`framework, n`: edges by what resolved them."""
    return edges.groupBy(F.substring("resolved_by", 11, 99).alias("framework")).agg(F.count("*").alias("n"))


def _python(path: str, text: str) -> list[tuple]:
    rows: list[tuple] = []

    def visit(node: ast.AST, owner: str | None, inside: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                hidden = child.name.startswith("__") if owner else child.name.startswith("_")
                if not hidden:
                    rows.append(_row(path, "symbol", "method" if owner else "function", child.name, owner, None, child.lineno, child.end_lineno, True))
                visit(child, owner, child.name)
            elif isinstance(child, ast.ClassDef):
                rows.append(_row(path, "symbol", "class", child.name, None, None, child.lineno, child.end_lineno, not child.name.startswith("_")))
                rows.extend(_row(path, "relation", "EXTENDS", child.name, None, ast.unparse(b), child.lineno) for b in child.bases)
                visit(child, child.name, child.name)
            else:
                if isinstance(child, ast.ImportFrom):
                    rows.extend(_row(path, "relation", "IMPORTS", a.name, None, "." * child.level + (child.module or ""), child.lineno) for a in child.names)
                elif isinstance(child, ast.Call):
                    f = child.func
                    rows.append(_row(path, "relation", "CALLS", inside, owner, f.id if isinstance(f, ast.Name) else getattr(f, "attr", None), child.lineno, None, None, None, ast.unparse(f.value) if isinstance(f, ast.Attribute) else None))
                visit(child, owner, inside)

    visit(ast.parse(text), None, None)
    return rows


#: Patterns of declarations and relations for languages without a parser here: part, kind, pattern; groups `n` (name), `t` (target).
BY_LINE = {
    "js": [
        ("symbol", "function", r"^\s*(?P<x>export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+(?P<n>[A-Za-z_$][\w$]*)\s*\("),
        ("symbol", "class", r"^\s*(?P<x>export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<n>[A-Za-z_$][\w$]*)"),
        ("symbol", "constant", r"^(?P<x>export\s+)?const\s+(?P<n>[A-Za-z_$][\w$]*)\s*="),
        ("symbol", "method", r"^\s+(?:static\s+)?(?:async\s+)?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(?P<n>[A-Za-z_$][\w$]*)\s*\([^)]*\)\s*\{"),
        ("relation", "IMPORTS", r"^\s*import\s+(?P<n>.*?)\s+from\s+['\"](?P<t>\.[^'\"]*)['\"]"),
        ("relation", "EXTENDS", r"\bclass\s+(?P<n>[A-Za-z_$][\w$]*)\s+extends\s+(?P<t>[A-Za-z_$][\w$.]*)"),
        ("relation", "CALLS", r"(?<![\w$.])(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(?P<t>[A-Za-z_$][\w$]*)\s*\("),
    ],
    "java": [
        ("symbol", "class", r"^\s*(?P<x>public\s+)?(?:abstract\s+|final\s+|static\s+)*class\s+(?P<n>\w+)"),
        ("symbol", "interface", r"^\s*(?P<x>public\s+)?interface\s+(?P<n>\w+)"),
        ("symbol", "enum", r"^\s*(?P<x>public\s+)?enum\s+(?P<n>\w+)"),
        ("symbol", "constructor", r"^\s+(?P<x>public\s+)?(?:protected\s+|private\s+)?(?P<n>[A-Z]\w*)\s*\([^)]*\)\s*(?:throws\s+[\w, ]+)?\{"),
        ("symbol", "method", r"^\s+(?P<x>public\s+)?(?:protected\s+|private\s+|static\s+|final\s+|synchronized\s+)*(?!(?:public|protected|private|static|final|synchronized|return|new|else|throw)\b)[\w<>\[\],.?][\w<>\[\],.? ]*\s+(?!if\b|for\b|while\b|switch\b|catch\b)(?P<n>\w+)\s*\([^)]*\)\s*(?:throws\s+[\w, ]+)?\{"),
        ("symbol", "field", r"^\s+(?P<x>public\s+)?(?:protected\s+|private\s+|static\s+|final\s+)+[\w<>\[\],.? ]+\s+(?P<n>\w+)\s*(?:=|;)"),
        ("relation", "IMPORTS", r"^import\s+(?:static\s+)?(?P<t>[\w.]+(?:\.\*)?);"),
        ("relation", "EXTENDS", r"\b(?:class|interface)\s+(?P<n>\w+)[^{]*?\bextends\s+(?P<t>\w+)"),
        ("relation", "IMPLEMENTS", r"\bclass\s+(?P<n>\w+)[^{]*?\bimplements\s+(?P<t>\w+)"),
        ("relation", "CALLS", r"(?<!\w)(?!if\b|for\b|while\b|switch\b|catch\b|return\b|new\b)(?P<t>\w+)\s*\("),
    ],
    "mybatis": [("symbol", "mybatis-statement", r"<(?P<o>select|insert|update|delete|sql)\b[^>]*\bid\s*=\s*[\"'](?P<n>[^\"']+)[\"']"), ("relation", "CALLS", r"<include\s+refid\s*=\s*[\"'](?P<t>[^\"']+)[\"']")],
    "vue": [("symbol", "component", r"^\s*name\s*:\s*['\"](?P<n>[\w-]+)['\"]"), ("symbol", "method", r"^\s{2,}(?:async\s+)?(?!if\b|for\b|while\b|switch\b|catch\b)(?P<n>[a-zA-Z_$][\w$]*)\s*\([^)]*\)\s*\{")],
    "svelte": [("symbol", "method", r"^\s*(?P<x>export\s+)?(?:async\s+)?function\s+(?P<n>[A-Za-z_$][\w$]*)"), ("symbol", "variable", r"^\s*(?P<x>export)\s+let\s+(?P<n>[A-Za-z_$][\w$]*)")],
    "liquid": [("relation", "RENDERS", r"\{%[-]?\s*(?:render|include|section)\s+['\"](?P<t>[\w\-./]+)['\"]")],
}


_STRINGS = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`")
_OWNERS = ("class", "interface", "enum")


def _closing(rows: list[list], text: str) -> None:
    """Gives the symbols found in a source with braces their last line, and members their owner: the innermost class that is open where they stand."""
    starts: dict[int, list[list]] = {}
    for r in rows:
        if r[1] == "symbol":
            starts.setdefault(r[6], []).append(r)
    depth, open_ = 0, []
    for n, line in enumerate(blank_comments(text, "c").split("\n"), 1):
        bare = _STRINGS.sub("", line)
        owner = next((s[3] for _, s in reversed(open_) if s[2] in _OWNERS), None)
        for r in starts.get(n, []):
            if owner and r[2] not in _OWNERS:
                r[4] = owner
            if "{" in bare and r[2] not in ("field", "variable"):
                open_.append((depth, r))
        for c in bare:
            depth += (c == "{") - (c == "}")
            while c == "}" and open_ and depth <= open_[-1][0]:
                open_.pop()[1][7] = n
    for _, r in open_:
        r[7] = text.count("\n") + 1


def extract(files: DataFrame) -> DataFrame:
    """Symbols and relations of source files (`path, text, lang`) as rows of FOUND; Python is parsed, other languages are read line by line, their braces matched.

    A file that doesn't parse gives one row of part 'error'; an unknown language gives nothing; null texts are empty; a mapper
    without namespace gives nothing.
    """
    compiled = {lang: [(part, kind, re.compile(p)) for part, kind, p in rules] for lang, rules in BY_LINE.items()}

    def scan(path, text, lang):
        if lang == "py":
            return _python(path, text)
        rows, inside, owner = [], None, None
        if lang == "mybatis":
            space = re.search(r"<mapper\b[^>]*\bnamespace\s*=\s*[\"']([^\"']+)[\"']", text)
            if not space:
                return []
            owner = space.group(1).rsplit(".", 1)[-1]
        base = re.sub(r"\.\w+$", "", path.rsplit("/", 1)[-1]) if path else None
        if lang in ("vue", "svelte"):
            owner = base
        for n, line in enumerate(text.split("\n"), 1):
            for part, kind, pattern in compiled.get(lang, []):
                for m in pattern.finditer(line):
                    g = m.groupdict()
                    if part == "symbol":
                        inside = g["n"]
                        if not (kind == "component" and inside == base):
                            rows.append(list(_row(path, part, kind, g["n"], owner, g.get("o"), n, n, bool(g.get("x")))))
                    elif kind != "CALLS" or g["t"] != inside:
                        rows.append(list(_row(path, part, kind, g.get("n") or inside, None, g["t"], n, n)))
        if lang in ("js", "java"):
            _closing(rows, text)
        if lang in ("vue", "svelte", "liquid") and path:
            kind = {"snippets": "snippet", "sections": "section", "layout": "layout"}.get(path.rsplit("/", 2)[-2] if "/" in path else "", "template") if lang == "liquid" else "component"
            rows.append(_row(path, "symbol", kind, base, None, None, 1, text.count("\n") + 1, True))
        return [tuple(r) for r in rows]

    return _batches(files, scan)


def indexed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two passes of an index over rows of `extract`: all symbols, then the relations with their ends resolved among them.

    Symbols are `id, name, path, kind, parent, line, line_end, exported, lang`, one for each id (the first line).  Relations are
    `src, dst, kind, line`: a name means the symbol of its own file, else the last of that name by path and line; calls of
    unknown names are left out, other unknown ends stay as they are written.  Members belong to the symbol that is
    their parent by name, in their file first, or to the name itself.
    """
    s = found.where("part = 'symbol'").withColumn("id", symbol_id(F.col("path"), F.col("name"), F.col("parent")))
    s = s.groupBy("id").agg(F.min(F.struct("line", "line_end", "name", "path", "kind", "parent", "exported")).alias("r")).select("id", "r.*")
    by_file = s.groupBy("path", "name").agg(F.max_by("id", "line").alias("_near"))
    by_name = name_map(s, ["path", "line"]).withColumnRenamed("id", "_far")

    def ends(rows: DataFrame, key: str) -> DataFrame:
        near = by_file.withColumnRenamed("name", key)
        return rows.join(near, ["path", key], "left").join(by_name.withColumnRenamed("name", key), key, "left").withColumn("_to", F.coalesce("_near", "_far")).drop("_near", "_far")

    rel = found.where("part = 'relation'").select("path", "kind", "name", "target", "line")
    module = resolve_module(F.col("path"), F.regexp_replace("target", r"^\.(?=[A-Za-z_])", "./"))
    paths = s.select("path").distinct().select(F.col("path").alias("_file"), F.regexp_replace("path", r"\.\w+$", "").alias("_module"))
    imports = rel.where("kind = 'IMPORTS'").withColumn("_module", module).join(paths, "_module", "left")
    imports = imports.select(F.col("path").alias("src"), F.coalesce("_file", "_module", "target").alias("dst"), "kind", "line")
    others = ends(rel.where("kind <> 'IMPORTS' and target is not null"), "target").where("kind <> 'CALLS' or _to is not null")
    around = s.where(F.col("kind") != "field")
    others = enclosing(others.select("path", "kind", "line", F.coalesce("_to", "target").alias("dst")), around).select(F.col("inside").alias("src"), "dst", "kind", "line")
    members = ends(s.where("parent is not null").select("id", "path", "parent", "line"), "parent").select(F.col("id").alias("src"), F.coalesce("_to", "parent").alias("dst"), F.lit("MEMBER_OF").alias("kind"), "line")
    return s, imports.unionByName(others).unionByName(members).where("src <> dst").distinct()


def _containing(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """`wanted, id`: symbols whose id holds a name, letter case ignored; they meet on the first three characters of the name."""
    low = F.lower("id")
    ids = symbols.select("id", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("id")), lambda i: F.array(*[F.substr(low, i, F.lit(n)) for n in (1, 2, 3)]))))).alias("_g")).distinct()
    keys = asked.select("wanted", F.substring(F.lower("wanted"), 1, 3).alias("_g"))
    return keys.join(ids, "_g").where(F.contains(low, F.lower("wanted"))).select("wanted", "id")


def scoped_names(symbols: DataFrame, asked: DataFrame, most: int = 20) -> DataFrame:
    """`wanted, id, stage, candidates`: what a name (`wanted`) means: an id, else `Parent.member`, else a name, else a part of an id or name.

    With one hit at the first stage that has any it is resolved; several are listed in `candidates` (up to `most`, by id); a part
    that fits more than `most` symbols means nothing.
    """
    low = symbols.select("id", "name", "parent")
    w = asked.select("wanted").where("wanted <> ''").distinct()
    dotted = w.where(F.contains("wanted", F.lit(".")) & ~F.contains("wanted", F.lit("/")))
    last = F.element_at(F.split("wanted", r"\."), -1)
    owner = F.element_at(F.split("wanted", r"\."), -2)
    stages = [
        w.join(low, w["wanted"] == low["id"]),
        dotted.join(low, (last == low["name"]) & (owner == low["parent"])),
        w.join(low, w["wanted"] == low["name"]),
        _containing(w, low),
    ]
    rows = None
    for i, j in enumerate(stages):
        one = j.select("wanted", "id", F.lit(i).alias("stage")).distinct()
        rows = one if rows is None else rows.unionByName(one)
    first = rows.groupBy("wanted").agg(F.min("stage").alias("stage"))
    ranked = rows.join(first, ["wanted", "stage"]).withColumn("n", F.row_number().over(Window.partitionBy("wanted").orderBy("id"))).where(F.col("n") <= most + 1)
    out = ranked.groupBy("wanted", "stage").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("id")).alias("all"))
    stage = F.element_at(F.array(*map(F.lit, ("id", "member", "name", "part"))), F.col("stage") + 1)
    known = (F.col("n") > 1) & ((F.col("n") <= most) | (F.col("stage") < 3))
    found = out.select("wanted", F.when(F.col("n") == 1, F.col("all")[0]).alias("id"), stage.alias("stage"), F.when(known, F.slice("all", 1, most)).otherwise(F.array().cast("array<string>")).alias("candidates"))
    return asked.select("wanted").distinct().join(found, "wanted", "left")


def provenance(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """`start, resolved_by, n`: direct callers of each target (`start`) by what resolved their call; 'name' where nothing says so."""
    hit = edges.join(targets.select(F.col("start").alias("dst")).distinct(), "dst", "left_semi").where("src <> dst")
    one = hit.groupBy(F.col("dst").alias("start"), "src").agg(F.min(F.struct("line", F.coalesce("resolved_by", F.lit("name")).alias("by"))).alias("r"))
    return one.groupBy("start", F.col("r.by").alias("resolved_by")).agg(F.count("*").alias("n"))


# How sources declare routes and models.
ROUTES = [r"\.(get|post|put|patch|delete|all)\s*\(\s*['\"`]([^'\"`]+)['\"`]", r"@(Get|Post|Put|Patch|Delete|All)\s*\(\s*['\"`]([^'\"`]*?)['\"`]\s*\)", r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE)\s*\(()"]
MODELS = [("prisma", r"model\s+(\w+)\s*\{"), ("drizzle", r"export\s+const\s+\w+\s*=\s*\w+Table\s*\(\s*['\"`](\w+)['\"`]")]


def routes(files: DataFrame) -> DataFrame:
    """`path, method, route` of HTTP routes that the sources declare; a handler without a route of its own has that of its file."""
    found = F.concat(*[F.transform(F.arrays_zip(F.regexp_extract_all("text", F.lit("(?i)" + p), F.lit(1)).alias("m"), F.regexp_extract_all("text", F.lit("(?i)" + p), F.lit(2)).alias("r")), lambda x: F.struct(F.upper(x["m"]).alias("method"), F.when(x["r"] == "", F.col("path")).otherwise(x["r"]).alias("route"))) for p in ROUTES])
    return files.select("path", F.explode(found).alias("f")).select("path", "f.method", "f.route").distinct()


def models(files: DataFrame) -> DataFrame:
    """`path, model` of data models that the sources declare, by the names of their tables."""
    found = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for _, p in MODELS])
    return files.select("path", F.explode(found).alias("model")).distinct()


_COMMENTS = {
    "c": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)", re.S),
    "py": re.compile(r"#[^\n]*|(\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')", re.S),
    "rb": re.compile(r"^=begin.*?^=end[^\n]*|#[^\n]*|(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')", re.S | re.M),
    "php": re.compile(r"(?://|#(?!\[))[^\n]*|/\*.*?(?:\*/|\Z)|(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')", re.S),
}


def blank_comments(text: str | None, style: str) -> str | None:
    """A source with comments turned into blanks of the same length, lines and strings kept."""
    if text is None:
        return None
    return _COMMENTS[style].sub(lambda m: m.group() if m.group(1) is not None else re.sub(r"[^\n]", " ", m.group()), text)


def without_comments(style: str):
    """A column function over source texts, Arrow-batched."""
    return F.pandas_udf(lambda texts: texts.map(lambda t: blank_comments(t, style)), T.StringType())


# How a text mentions entities, by kind, and how often it must for the noisy ones.
MENTIONS = {
    "explicit": (r"`((?:BIZ|TECH|PATTERN|INCIDENT|RULE|FLOW|ENTITY|DECISION|GOTCHA):[^`]+)`", 1),
    "tech-decision": (r"\b(?:use|chose|prefer|switch(?:ed)?\s+to|migrate(?:d)?\s+to|adopt(?:ed)?|implement(?:ed)?\s+with)\s+([A-Z][\w.]+(?:\s+[A-Z][\w.]+)?)", 1),
    "error-pattern": (r"(?i)\b(?:error|failed|bug|issue|broken|crash|exception|timeout)\s*[:.]?\s+([^\n.]{10,80})", 1),
    "pascal-case": (r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b", 3),
    "all-caps": (r"\b([A-Z][A-Z0-9]+(?:_[A-Z0-9]+)+)\b", 3),
}


def mentions(texts: DataFrame, key: str = "doc_id", most: int = 10) -> DataFrame:
    """`doc_id, name, kind, n`: up to `most` entities that each text mentions, the explicit ones first; a name has its first kind only."""
    parts = [texts.select(key, F.explode(F.regexp_extract_all("text", F.lit(edged(p)), F.lit(1))).alias("name"), F.lit(i).alias("_k")).groupBy(key, "name", "_k").agg(F.count("*").alias("n")).where(F.col("n") >= least) for i, (p, least) in enumerate(MENTIONS.values())]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    one = rows.groupBy(key, "name").agg(F.min(F.struct("_k", "n")).alias("b")).select(key, "name", "b.*")
    w = Window.partitionBy(key).orderBy("_k", F.col("n").desc(), "name")
    kinds = F.array(*[F.lit(k) for k in MENTIONS])
    return one.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select(key, "name", kinds[F.col("_k")].alias("kind"), "n")


def prompt_keywords(text: Column) -> Column:
    """Path segments, backticked words, prefixed names and the first five words of a prompt, each once."""
    paths = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"[\w.-]+(?:/[\w.-]+)+"), F.lit(0)), lambda p: F.split(p, "/")))
    ticks = F.regexp_extract_all(text, F.lit(r"`([^`\n]+)`"), F.lit(1))
    refs = F.regexp_extract_all(text, F.lit(edged(r"\b[A-Z]{2,10}:\w+")), F.lit(0))
    words = F.split(F.trim(F.regexp_replace(text, f"^{BLANK}+", "")), f"{BLANK}+")
    return F.array_distinct(F.transform(F.concat(paths, ticks, refs, F.slice(words, 1, 5)), lambda w: F.lower(w)))


def files_at_risk(impact: DataFrame, rules: DataFrame) -> DataFrame:
    """`rule_id, depth`: observations (`id, path`) that name an impacted file (`path, depth`), at the least depth."""
    i = impact.select(normal_path(F.col("path")).alias("path"), "depth")
    return rules.select(F.col("id").alias("rule_id"), normal_path(F.col("path")).alias("path")).join(i, "path").groupBy("rule_id").agg(F.min("depth").alias("depth"))
