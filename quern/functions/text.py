"""Column functions over texts, names, paths and observations; all run inside the JVM.

Each tokeniser has its own rules on purpose: results of one must not leak into another.
A null text gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import vocab as V

OBSERVATION = r"^\[(\d\.?\d*)(?:\|(\d{4}-\d{2}-\d{2}))?\]\s*"


def _none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


#: A word boundary between ASCII word characters and anything else; `\\b` alone also counts other letters.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def edged(pattern: str) -> str:
    return pattern.replace(r"\b", EDGE)


# Fixed value: white space beyond ASCII counts too when prompts are cut into words.
BLANK = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


# --- tokenisers -----------------------------------------------------------------------------------


def raw_words(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return all_matches(text, r"[\p{L}\p{N}_]+")


def index_words(text: Column) -> Column:
    """Runs of letters and digits in lower case: what full-text search indexes."""
    return all_matches(F.lower(text), r"[\p{L}\p{N}]+")


def word_parts(word: Column) -> Column:
    """The parts of an identifier between case changes, digits and underscores."""
    s = F.regexp_replace(word, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    s = F.regexp_replace(s, r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2")
    s = F.regexp_replace(s, r"(\p{L})(\p{N})", "$1 $2")
    s = F.regexp_replace(s, r"(\p{N})(\p{L})", "$1 $2")
    return F.filter(F.split(s, r"[\s_]+"), lambda p: p != "")


def is_identifier(word: Column) -> Column:
    """Shaped like an identifier: three digits in a row, an underscore, mixed case, or capitals, and of three characters at least."""
    mixed = word.rlike(r"\p{Ll}\p{Lu}") | word.rlike(r"\p{Lu}\p{Lu}\p{Ll}")
    return (F.length(word) >= 3) & (word.rlike(r"\d{3}") | word.contains("_") | mixed | word.rlike(r"^[\p{Lu}\p{N}]*\p{Lu}[\p{Lu}\p{N}]*$"))


def search_tokens(text: Column) -> Column:
    """Distinct tokens of exact-token search: words and their parts, without stop words and short prose."""
    words = raw_words(text)
    # words without capitals, digits and underscores have no parts
    with_parts = F.flatten(F.transform(words, lambda w: F.when(w.rlike(r"[^\p{Ll}]") & (F.size(word_parts(w)) > 1), F.concat(F.array(w), word_parts(w))).otherwise(F.array(w))))
    stop = F.array(*[F.lit(s) for s in V.SEARCH_STOP])
    kept = F.filter(with_parts, lambda w: ((F.length(w) >= 3) | is_identifier(w)) & ~F.array_contains(stop, F.lower(w)))
    return F.array_distinct(F.transform(kept, lambda w: F.lower(w)))


def prefix_terms(query: Column) -> Column:
    """Terms of a prefix query: operators dropped, split at white space."""
    return F.filter(F.split(F.lower(F.regexp_replace(query, r'["^()+\-]', " ")), r"\s+"), lambda t: t != "")


def quality_tokens(text: Column) -> Column:
    """Distinct ASCII words of three characters at least, without stop words."""
    stop = F.array(*[F.lit(s) for s in V.QUALITY_STOP])
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))


def recall_keywords(text: Column, stop: list[str] = V.SEARCH_STOP) -> Column:
    """Distinct lower-case words of three characters at least, without stop words."""
    words = F.split(F.lower(text), r"[\s,.;:!?()\[\]{}\"'`<>/\\|@#$%^&*+=~_\-]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(F.array(*[F.lit(s) for s in stop]), w)))


def code_terms(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), r"[\s_\-]+"), lambda t: F.length(t) > 1)


def skill_terms(query: Column) -> Column:
    words = F.split(F.lower(query), r"[\s\-_:;,.!?()\[\]{}\"'`/\\|<>@#$%^&*+=~]+")
    return F.filter(words, lambda t: (F.length(t) > 1) & ~F.array_contains(F.array(*[F.lit(s) for s in V.SKILL_NOISE]), t))


def blank_terms(query: Column) -> Column:
    return F.filter(F.split(F.trim(query), r"\s+"), lambda t: t != "")


# --- observations and names -----------------------------------------------------------------------


def parse_observation(raw: Column) -> Column:
    """`confidence, obs_date, text` of `[confidence|date] text`; 0.8 and null without a bracket."""
    number = F.regexp_extract(raw, OBSERVATION, 1)
    day = _none_if_empty(F.regexp_extract(raw, OBSERVATION, 2))
    return F.struct(F.when(number == "", F.lit(0.8)).otherwise(F.least(number.try_cast("double"), F.lit(1.0))).alias("confidence"), day.alias("obs_date"), F.regexp_replace(raw, OBSERVATION, "").alias("text"))


def format_observation(confidence: Column, day: Column, text: Column) -> Column:
    return F.concat(F.lit("["), confidence.cast("string"), F.when(day.isNotNull(), F.concat(F.lit("|"), day)).otherwise(F.lit("")), F.lit("] "), text)


def with_default_prefix(raw: Column, day: str) -> Column:
    """Texts that don't start with a bracket get the default one."""
    return F.when(raw.startswith("["), raw).otherwise(F.concat(F.lit(f"[0.8|{day}] "), raw))


def writer_category(text: Column) -> Column:
    return _none_if_empty(F.regexp_extract(text, r"^([A-Z]{2,10}):", 1))


def prefix_word(text: Column) -> Column:
    """The word before the first colon in lower case, as contradictions are grouped by."""
    return _none_if_empty(F.lower(F.regexp_extract(text, r"^(\w+):", 1)))


def observation_key(text: Column) -> Column:
    return _none_if_empty(F.regexp_extract(F.regexp_replace(text, r"^\[[^\]]*\]\s*", ""), r"^([A-Z][A-Z0-9_]{1,24})\s*:", 1))


def name_prefix(name: Column) -> Column:
    return F.upper(F.trim(F.split(name, ":")[0]))


def scope_segment(name: Column) -> Column:
    """The second segment of a name, squeezed; null without one of three characters."""
    s = squeezed(F.try_element_at(F.split(name, ":"), F.lit(2)))
    return F.when(F.length(s) >= 3, s)


def scope_key(name: Column) -> Column:
    """The first segment after the prefix that is no mere modifier, squeezed; null without one."""
    parts = F.filter(F.transform(F.split(name, ":"), lambda p: F.trim(p)), lambda p: p != "")
    rest = F.filter(F.transform(F.slice(parts, 2, 1 << 20), lambda p: squeezed(p)), lambda p: ~p.isin(V.MODIFIERS))
    return F.try_element_at(rest, F.lit(1))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[\s\-_]", "")


def identity_key(id_: Column, entity_id: Column, scope: Column, name: Column) -> Column:
    """The first of id, entity id, scope::name and name that is there."""
    return F.coalesce(_none_if_empty(id_), _none_if_empty(entity_id), F.when(scope != "", F.concat_ws("::", scope, name)), name)


def decayed(confidence: Column, age_days: Column) -> Column:
    """Confidence after half-lives of 30, 70 or 180 days; unchanged for a null or negative age."""
    half = F.when(confidence <= 0.5, 30.0).when(confidence <= 0.8, 70.0).otherwise(180.0)
    return F.when(age_days.isNull() | (age_days < 0), confidence).otherwise(confidence * F.exp(-F.log(F.lit(2.0)) / half * age_days))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def rounded(x: Column, places: int) -> Column:
    """Half up on the binary value, the same in every engine."""
    return F.floor(x * float(10**places) + 0.5) / float(10**places)


# --- paths and cases ------------------------------------------------------------------------------


def normal_path(path: Column) -> Column:
    """Slashes forward, no leading `./`, no `:line` at the end, trimmed."""
    s = F.trim(F.regexp_replace(path, r"\\", "/"))
    return F.regexp_replace(F.regexp_replace(s, r"^\./", ""), r":\d+(-\d+)?$", "")


def listed_files(text: Column) -> Column:
    """The paths of a `FILES: a, b` observation; empty for others."""
    body = F.regexp_extract(text, r"^FILES:\s*(.*)$", 1)
    return F.filter(F.transform(F.split(body, r"[,;]"), lambda p: normal_path(p)), lambda p: p != "")


def path_ends_match(a: Column, b: Column) -> Column:
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def shared_segments(a: Column, b: Column) -> Column:
    """Number of leading path segments that two files share."""
    same = F.zip_with(F.split(a, r"[/\\]"), F.split(b, r"[/\\]"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same)).cast("int")


def resolve_module(importer: Column, module: Column) -> Column:
    """A relative module path as a path from the root; null for bare names."""
    base = F.slice(F.split(F.regexp_replace(importer, r"\\", "/"), "/"), F.lit(1), F.greatest(F.size(F.split(F.regexp_replace(importer, r"\\", "/"), "/")) - 1, F.lit(0)))
    steps = F.filter(F.split(F.regexp_replace(module, r"\\", "/"), "/"), lambda s: (s != ".") & (s != ""))
    walk = F.aggregate(steps, base, lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    return F.when(module.startswith("."), F.array_join(walk, "/"))


def pascal_case(text: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(text, r"[-_.\s]+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def process_label(name: Column) -> Column:
    """A function's name without the verb of an entry point, first letter capital."""
    cut = F.regexp_replace(name, r"^(handle|on|register|setup|init|run|start|process|execute)", "")
    base = F.when(F.length(cut) < 2, name).otherwise(cut)
    return F.concat(F.upper(F.substring(base, 1, 1)), F.substring(base, 2, 1 << 20))


# --- errors and messages --------------------------------------------------------------------------


def error_marker(text: Column) -> Column:
    """The marker that shows a failed call in the first 300 characters; null if none does."""
    head = F.substring(text, 1, 300)
    out = F.when(text.rlike(r"^\s*Error:"), F.lit("Error:"))
    for m in V.ERROR_MARKERS:
        out = out.when(F.contains(head, F.lit(m)), F.lit(m))
    return out


def error_fingerprint(text: Column) -> Column:
    """The first line that shows an error (else the first), with paths, hashes and numbers replaced, 160 characters."""
    lines = F.split(text, "\n")
    s = F.coalesce(F.try_element_at(F.filter(lines, lambda x: error_marker(x).isNotNull()), F.lit(1)), lines[0])
    for pattern, to in ((r"[A-Za-z]:[\\/][^\s'\"]+", "<path>"), (r"/[^\s'\"]{4,}", "<path>"), (r"(?i)\b[0-9a-f]{8,}\b", "<hash>"), (r"\b\d+\b", "<n>")):
        s = F.regexp_replace(s, edged(pattern), to)
    return F.substring(F.trim(s), 1, 160)


# What a message's private or varying parts are replaced by, in this order.
MESSAGE_RULES = [
    (r"-----BEGIN[\s\S]*?(?:-----END[^\n]*|\z)", "<secret>"),
    (r"(?i)\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis)://\S+", "<url>"),
    (r"(?i)\b(?:password|token|secret|authorization|cookie|credential|api[_-]?key)\s*[:=]\s*[^\s,;]+", "<secret>"),
    (r"'[^'\"`\n]*'|\"[^'\"`\n]*\"|`[^'\"`\n]*`", "<quoted>"),
    (r"(?i)\b[a-f0-9]{8}-(?:[a-f0-9]{4}-){3}[a-f0-9]{12}\b", "<uuid>"),
    (r"\b\d{4}-\d{2}-\d{2}(?:T[\d:.+-]+Z?)?", "<date>"),
    (r"(?:[A-Za-z]:[\\/]|/(?:home|Users|tmp|var)/)[^\s,)]+", "<path>"),
    (r"\b[a-zA-Z0-9_+/=-]{24,}\b", "<opaque>"),
    (r"\b\d+(?:\.\d+)?\b", "<number>"),
    (BLANK + "+", " "),
]


def normal_message(text: Column) -> Column:
    s = F.substring(text, 1, 2048)
    for pattern, to in MESSAGE_RULES:
        s = F.regexp_replace(s, edged(pattern), to)
    return F.trim(s)


def capped_output(text: Column, limit: int = 15_000) -> Column:
    """At most `limit` characters, cut at the last newline if that lies in the last fifth."""
    head = F.substring(text, 1, limit)
    back = F.locate("\n", F.reverse(head))
    at = F.lit(limit) - back
    return F.when(F.length(text) <= limit, text).when((back > 0) & (at > 0.8 * limit), F.substr(head, F.lit(1), at)).otherwise(head)


# Markdown that is dropped or unwrapped, in this order.
MARKDOWN_RULES = [(r"(?s)```.*?```", ""), (r"`([^`\n]*)`", "$1"), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}[ \t]+", ""), (r"(?m)^>[ \t]?", ""), (r"(?m)^[-*_]{3,}[ \t]*$", ""), (r"\*\*([^*\n]+)\*\*", "$1"), (r"\*([^*\n]+)\*", "$1"), (r"\n{3,}", "\n\n")]


def plain_markdown(text: Column) -> Column:
    """Markdown without fences, headings, emphasis, links, quotes and rules; blank lines squeezed."""
    s = text
    for pattern, to in MARKDOWN_RULES:
        s = F.regexp_replace(s, pattern, to)
    return F.trim(s)


def task_kind(text: Column) -> Column:
    """'bug', 'feature' or 'exploration' by words of a prompt, in this order; null without any."""
    low = F.lower(text)
    has = lambda words: low.rlike(edged(rf"\b({words})\b"))
    return F.when(has("fix|bug|error|crash|broken|fail(s|ed|ing)?"), "bug").when(has("add|implement|create|build|feature|support"), "feature").when(has("how|why|what|where|explain|understand|explore|find"), "exploration")


def recall_gate(prompt: Column) -> Column:
    """Why a prompt is worth a look into the store ('long', 'code token', 'code word', 'knowledge word', 'medium') or not ('empty', 'short')."""
    t, low = F.regexp_replace(prompt, f"^{BLANK}+|{BLANK}+$", ""), F.lower(prompt)
    n = F.size(F.split(t, f"{BLANK}+"))
    code = t.rlike(edged(r"\b(?:[a-z]+(?:[A-Z][a-z]*)+|[A-Z][a-z]+(?:[A-Z][a-z]*)+|[a-z]+(?:_[a-z]+)+)\b")) | t.rlike(edged(r"\b[\w\-./\\]+\.(?:m?[jt]sx?|py|java|go|rs|rb|php|cs|kt|swift|sql|sh|md|json|ya?ml|toml|html|css|xml)\b")) | t.rlike(edged(r"\b[\w\-]+[/\\][\w\-./\\]+"))
    words = lambda ws: low.rlike(edged(r"\b(?:" + "|".join(ws) + r")\b"))
    return F.when(t.isNull() | (t == ""), "empty").when(n > 30, "long").when(code, "code token").when(words(V.CODE_WORDS), "code word").when(words(V.KNOWLEDGE_WORDS), "knowledge word").when(n <= 8, "short").otherwise("medium")


def json_or_words(text: Column) -> Column:
    """A list given as JSON or as text between commas, trimmed."""
    return F.coalesce(F.from_json(text, "array<string>"), F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))


def loose_boolean(text: Column) -> Column:
    return F.when(F.lower(text).isin("true", "1", "yes"), True).when(F.lower(text).isin("false", "0", "no"), False)


def kebab_to_pascal(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def output_text(payload: Column) -> Column:
    """A tool's output as plain text: a JSON list of parts, an object with `content` or `text`, or the text itself."""
    part = "array<struct<text:string>>"
    parts = F.from_json(payload, part)
    content = F.from_json(F.get_json_object(payload, "$.content"), part)
    join = lambda a: F.array_join(F.transform(a, lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    t = F.trim(payload)
    return F.when(t.startswith("[") & parts.isNotNull(), join(parts)).when(t.startswith("{") & content.isNotNull(), join(content)).when(t.startswith("{") & F.get_json_object(payload, "$.text").isNotNull(), F.get_json_object(payload, "$.text")).otherwise(payload)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hexadecimal HMAC-SHA-256 by its definition: two nested hashes over padded keys."""
    import hashlib

    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in k).hex()))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))), 256)


def write_problems(name: Column, texts: Column) -> Column:
    """What is wrong with an entity to be written: 'name' unless TIER:SCOPE:LABEL, 'tier' for an unknown tier, 'confidence' for a bracket over 1 or malformed."""
    tiers = sorted({p for r in V.ENTITY_RULES.values() for p in r[0].split()})
    bad = F.exists(texts, lambda t: t.rlike(r"^\[\d") & ~t.rlike(OBSERVATION) | (t.rlike(OBSERVATION) & (F.regexp_extract(t, OBSERVATION, 1).try_cast("double") > 1)))
    return F.array_compact(F.array(F.when(~name.rlike(r"^[^:]+:[^:]+:.+$"), "name"), F.when(~name_prefix(name).isin(tiers), "tier"), F.when(bad, "confidence")))


def scan_phases(path: Column) -> Column:
    """Which parts of a project a changed file concerns."""
    # Phase and the paths that belong to it.
    rules = [("identity", r"(^|/)(package\.json|pyproject\.toml|go\.mod|Cargo\.toml|README\.md)$"), ("schema", r"(^|/)(prisma|migrations?|schema)(/|\.)|\.sql$"), ("routes", r"(^|/)(routes?|controllers?|api)/"), ("tests", r"(^|/)(tests?|__tests__|spec)/|\.(test|spec)\."), ("ci", r"(^|/)\.github/|(^|/)(Dockerfile|docker-compose\.ya?ml)$"), ("source", r"\.(m?[jt]sx?|py|java|go|rs|rb|php|vue|svelte)$")]
    return F.array_compact(F.array(*[F.when(path.rlike(p), n) for n, p in rules]))


def loose_number(text: Column) -> Column:
    """A number given as text; null for anything else."""
    return F.when(F.trim(text).rlike(r"^-?\d+(\.\d+)?$"), F.trim(text).try_cast("double"))


def call_outcome(result: Column) -> Column:
    """`ok, output` of a call's result as JSON: `Ok` with or without `isError`, or `Err`; both null if it is neither, a tri-state on purpose."""
    r = F.from_json(result, "struct<Ok:struct<isError:boolean,content:array<struct<text:string>>>,Err:string>")
    ok = F.when(r["Err"].isNotNull(), False).when(r["Ok"].isNotNull(), ~F.coalesce(r["Ok"]["isError"], F.lit(False)))
    said = F.array_join(F.transform(r["Ok"]["content"], lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    return F.struct(ok.alias("ok"), F.coalesce(r["Err"], said).alias("output"))


def time_ordered_id(at: Column, unique: Column) -> Column:
    """An id in the form of a UUID of version 7: milliseconds, then bits of a hash of `unique`; the same input always gives the same id."""
    ms, h = F.lpad(F.lower(F.hex(F.unix_millis(at))), 12, "0"), F.sha2(unique, 256)
    return F.concat_ws("-", F.substring(ms, 1, 8), F.substring(ms, 9, 4), F.concat(F.lit("7"), F.substring(h, 1, 3)), F.concat(F.lit("8"), F.substring(h, 4, 3)), F.substring(h, 7, 12))
