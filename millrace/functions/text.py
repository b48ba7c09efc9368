"""Text columns: whitespace, hashes, tokens, similarity and templates. Everything is a Column of built-ins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in code search, control words and operators of a code shape.
STOPWORDS = [
    "class", "code", "corresponding", "final", "generation", "java", "original", "private", "production", "protected",
    "public", "refactored", "return", "static", "task", "test", "this", "void",
]
CONTROL_TOKENS = ["if", "else", "for", "while", "switch", "try", "catch", "throw"]
OPERATORS = ["==", "!=", ">=", "<=", "&&", "||", "+", "-", "*", "/", "%"]
# Headings of queries and evidence, and names of secrets.
QUERY_MARKERS = ["Production Java code:\n", "Original Java code:\n"]
EVIDENCE_MARKERS = ["\n\nCorresponding test code:\n", "\n\nRefactored Java code:\n"]
SECRET_NAMES = r"api[_-]?key|authorization|bearer|token|secret|password"

#: A quoted literal, a comment, an identifier, a number or any other visible character. Quantifiers are possessive,
#: so that a literal of any length can't exhaust the matcher's stack.
JAVA_TOKEN = r"""(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|//[^\n]*+|/\*.*?\*/|[A-Za-z_$][A-Za-z0-9_$]*+|[0-9]++(?:\.[0-9]++)?|\S"""


#: All white space, as the engine's regular expressions see it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Drop all leading and trailing white space (``trim`` drops spaces alone). Linear in the text, whatever runs it holds."""
    return F.btrim(col(c), F.lit(WHITE))


def normalize_text(c: Column | str) -> Column:
    """Runs of white space to single spaces, ends stripped; null becomes empty."""
    return F.btrim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " "))


def normalize_content(c: Column | str) -> Column:
    """Line ends to LF, spaces and tabs at line ends dropped, ends stripped."""
    unix = F.replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(unix, r"(?m)(?<![ \t])[ \t]++$", ""))


def content_hash(c: Column | str) -> Column:
    return F.sha2(normalize_content(c), 256)


def content_identity(c: Column | str) -> Column:
    """Hash that ignores how white space is laid out."""
    return F.sha2(normalize_text(c), 256)


def java_fingerprint(c: Column | str) -> Column:
    """The code's tokens without comments, joined by single spaces."""
    tokens = F.regexp_extract_all(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit(JAVA_TOKEN), F.lit(0))
    kept = F.filter(tokens, lambda t: ~(F.startswith(t, F.lit("//")) | F.startswith(t, F.lit("/*"))))
    return F.array_join(kept, " ")


def java_hash(c: Column | str) -> Column:
    """Hash of the lexical fingerprint, normalised like any content."""
    return content_hash(java_fingerprint(c))


def canonical_key(*parts: Column | str) -> Column:
    """Identity parts, stripped and lower-cased, joined by ``|``; nulls count as empty, backslashes as slashes."""
    clean = [F.lower(strip(F.replace(F.coalesce(col(p).cast("string"), F.lit("")), F.lit("\\"), F.lit("/")))) for p in parts]
    return F.concat_ws("|", *clean)


def joined_hash(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256)


def first_filled(*candidates: Column | str) -> Column:
    """The first candidate that isn't blank, else empty."""
    return F.coalesce(*[F.when(strip(col(c).cast("string")) != "", col(c).cast("string")) for c in candidates], F.lit(""))


def words(c: Column | str) -> Column:
    """Words between white space; an empty array for a blank text."""
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), r"(?U)\s+"), lambda w: w != "")


def token_count(c: Column | str) -> Column:
    return F.size(words(c))


def estimated_tokens(c: Column | str, floor: int = 0) -> Column:
    """A token for each four characters, rounded up; at least ``floor``."""
    return F.greatest(F.ceil(F.length(F.coalesce(col(c), F.lit(""))) / 4).cast("int"), F.lit(floor))


def truncate_tokens(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, 4 * max(0, n))


def token_f1(left: Column | str, right: Column | str) -> Column:
    """F1 of the two sets of lower-cased words; 1 if both are empty, 0 if one is."""
    a, b = (F.array_distinct(words(F.lower(F.coalesce(col(x), F.lit(""))))) for x in (left, right))
    common = F.size(F.array_intersect(a, b)).cast("double")
    precision, recall = common / F.size(b), common / F.size(a)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0) | (common == 0), 0.0)
        .otherwise(2 * precision * recall / (precision + recall))
    )


def text_metrics(given: Column | str, reference: Column | str, prediction: Column | str) -> dict[str, Column]:
    """Columns that describe a prediction beside its input and reference."""
    i, r, p = (F.coalesce(col(x), F.lit("")) for x in (given, reference, prediction))
    return {
        "exact_match": (strip(r) == strip(p)).cast("double"),
        "normalized_exact_match": (normalize_text(r) == normalize_text(p)).cast("double"),
        "prediction_length": F.length(p),
        "reference_length": F.length(r),
        "prediction_tokens": token_count(p),
        "output_non_empty": strip(p) != "",
        "output_differs_from_input": normalize_text(i) != normalize_text(p),
    }


def semantic_tokens(c: Column | str) -> Column:
    """Set of meaningful words of code: identifiers cut at case changes and underscores, lower case, stop words dropped."""
    raw = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0))
    parts = F.flatten(F.transform(raw, lambda w: F.split(F.lower(F.replace(F.regexp_replace(w, r"([a-z0-9])(?=[A-Z])", "$1 "), F.lit("_"), F.lit(" "))), " ")))
    return F.array_except(F.filter(parts, lambda w: F.length(w) > 1), F.array(*map(F.lit, STOPWORDS)))


def lexical_similarity(query: Column, document: Column) -> Column:
    """0.7 of the query's coverage and 0.3 of the Jaccard index of two token sets; 0 if one is empty."""
    both = F.size(F.array_intersect(query, document)).cast("double")
    score = 0.7 * both / F.size(query) + 0.3 * both / F.size(F.array_union(query, document))
    return F.when((F.size(query) == 0) | (F.size(document) == 0), 0.0).otherwise(score)


def after_first(c: Column | str, markers: Sequence[str]) -> Column:
    """What follows the first marker that occurs (in the markers' order), else the text."""
    c, out = col(c), col(c)
    for m in reversed(markers):
        out = F.when(F.contains(c, F.lit(m)), F.substr(c, F.instr(c, m) + len(m))).otherwise(out)
    return out


def before_first(c: Column | str, markers: Sequence[str]) -> Column:
    c, out = col(c), col(c)
    for m in reversed(markers):
        out = F.when(F.contains(c, F.lit(m)), F.substr(c, F.lit(1), F.instr(c, m) - 1)).otherwise(out)
    return out


def redact(c: Column | str) -> Column:
    """Mask what follows the name of a secret."""
    return F.regexp_replace(col(c), rf"(?i)({SECRET_NAMES})(\s*[:=]\s*)([^\s,;]+)", "$1$2[REDACTED]")


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), r"[^a-zA-Z0-9_.-]+", "-"), "^-+|-+$", "")


def preview(c: Column | str, size: int = 500) -> Column:
    c = col(c)
    return F.when(F.length(c) > size, F.concat(F.rtrim(F.substring(c, 1, size - 3)), F.lit("..."))).otherwise(c)


def strip_fence(c: Column | str) -> Column:
    """The inside of the first Markdown fence, else the text; stripped."""
    inner = F.regexp_extract(col(c), r"(?is)```(?:[a-z]+)?[ \t]*\n(.*?)```", 1)
    return strip(F.when(inner != "", inner).otherwise(col(c)))


def boundary_key(c: Column | str) -> Column:
    """How a header or footer line is recognised: lower case, single spaces, digits as ``#``."""
    return F.regexp_replace(normalize_text(F.lower(col(c))), r"[0-9]+", "#")


def retrieval_query(task: str, text: Column | str, requirements: Column | str = "", class_name: Column | str = "", method: Column | str = "") -> Column:
    """A task-aware search text: task, class, method and requirements where given, then the code under its heading."""
    names = {"testing": ("test generation", QUERY_MARKERS[0]), "refactoring": ("refactoring", QUERY_MARKERS[1])}
    if task not in names:
        raise ValueError(f"unknown task {task!r}")
    label, heading = names[task]
    lit = lambda x: F.lit("") if isinstance(x, str) and x == "" else strip(F.coalesce(col(x), F.lit("")))
    optional = [F.when(lit(x) != "", F.concat(F.lit(f"{k}: "), lit(x))) for k, x in (("Java class", class_name), ("Focal method", method), ("Requirements", requirements))]
    return F.concat_ws("\n\n", F.lit(f"Task: {label}"), *optional, F.concat(F.lit(heading), strip(text)))


def refactoring_type(name: Column | str, types: Sequence[str]) -> Column:
    out = F.lit("unknown")
    for t in reversed(types):
        out = F.when(F.contains(col(name), F.lit(t)), F.lit(t)).otherwise(out)
    return out


def process_status(code: Column | str, output: Column | str) -> Column:
    """Outcome of a build from its exit code and log."""
    o = col(output)
    return (
        F.when(col(code) == 0, "accepted")
        .when(F.contains(o, F.lit("COMPILATION ERROR")) | F.contains(o, F.lit("testCompile")), "compile_error")
        .when(o.rlike(r"Failures:\s*[1-9]|Errors:\s*[1-9]"), "test_error")
        .otherwise("maven_error")
    )


def test_directory(path: Column | str) -> Column:
    """Where tests of a source file go; null for paths that climb out or have no main folder."""
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    ok = F.contains(p, F.lit("src/main/java")) & ~p.rlike(r"(^|/)\.\.(/|$)") & ~p.rlike(r"^(/|[A-Za-z]:)")
    return F.when(ok, F.regexp_replace(F.regexp_replace(p, "src/main/java", "src/test/java"), "/[^/]*$", ""))


#: Aliases of the two tasks.
TASKS = {"testing": "testing", "test": "testing", "tests": "testing", "test_generation": "testing", "refactoring": "refactoring", "refactor": "refactoring"}


def resolve_task(c: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in TASKS.items() for x in kv])
    return F.element_at(known, F.regexp_replace(F.lower(strip(c)), "[ -]+", "_"))


def class_name(c: Column | str) -> Column:
    """The first public class of generated Java, else the first class; empty without one."""
    t = strip_fence(c)
    public = F.regexp_extract(t, r"\bpublic\s+(?:final\s+|abstract\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)", 1)
    return F.when(public != "", public).otherwise(F.regexp_extract(t, r"\bclass\s+([A-Za-z_$][A-Za-z0-9_$]*)", 1))


def package_name(c: Column | str) -> Column:
    """The package of generated Java, empty without one."""
    return F.regexp_extract(strip_fence(c), r"(?m)^\s*package\s+([A-Za-z_$][A-Za-z0-9_$.]*)\s*;", 1)


def scalar_kind(c: Column | str) -> Column:
    """What a literal of a command line is: bool, int, float or str; null for null."""
    t = col(c)
    low = F.lower(strip(t))
    whole = t.try_cast("bigint").isNotNull() & ~F.contains(t, F.lit("."))
    return F.when(low.isin("true", "false"), "bool").when(whole, "int").when(t.try_cast("double").isNotNull() & t.rlike(r"^\s*[-+]?[0-9.]"), "float").when(t.isNotNull(), "str")
