"""Source of languages without a parser here, read by words: decisions, type escapes, shared state, declarations.

All are built-in expressions over the text without its comments and strings, so they stay in the JVM.  They read
words and not syntax: what they can't tell apart is said at each, and a language without a rule has NULL, not 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLASHES = ["rust", "go", "java", "csharp", "javascript", "typescript", "c"]
SUFFIXES = {
    "py": "python", "rs": "rust", "go": "go", "java": "java", "cs": "csharp", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "c": "c", "h": "c", "rb": "ruby",
}
SLASH_NOISE = r"(?s)/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n]){1,40}'|`(?:\\.|[^`\\])*`"
HASH_NOISE = r"(?s)#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
#: One for each branch and each arm; an if expression and a ternary (a question mark with space around it) are one.
DECISIONS = {
    "rust": r"\bif\b|=>", "go": r"\bif\b|\bcase\b|\bdefault\b", "java": r"\bif\b|\bcase\b|\bdefault\b|\s\?\s", "csharp": r"\bif\b|\bcase\b|\bdefault\b|\s\?\s",
    "javascript": r"\bif\b|\bcase\b|\bdefault\s*:|\s\?\s", "typescript": r"\bif\b|\bcase\b|\bdefault\s*:|\s\?\s", "c": r"\bif\b|\bcase\b|\bdefault\s*:|\s\?\s",
    "ruby": r"\bif\b|\bunless\b|\belsif\b|\bwhen\b|\s\?\s", "python": r"\bif\b|\belif\b|(?m)^\s*case\b",
}
ESCAPES = {"java": r"\bObject\b|@SuppressWarnings\b", "csharp": r"\bobject\b|\bdynamic\b", "typescript": r"\b(?:any|unknown)\b", "go": r"\bany\b", "python": r"\bAny\b"}
IMPORTS = r"(?m)^\s*(?:import|using|from)\b[^\n]*"
#: (severity, kind, pattern of the place; its first group is the name)
SURFACE = {
    "rust": [("exposed", "unsafe_impl", r"\bunsafe\s+impl\b[^{]*?\b(Send|Sync)\b"), ("exposed", "static_mut", r"\bstatic\s+mut\s+(\w+)"), ("candidate", "relaxed_ordering", r"\bOrdering\s*::\s*(Relaxed)\b")],
    "java": [("review", "static_mutable_field", r"\bstatic\s+(?!final\b)(?:(?:public|private|protected|volatile|transient)\s+)*(?:Map|HashMap|LinkedHashMap|TreeMap|List|ArrayList|LinkedList|Set|HashSet|LinkedHashSet|TreeSet|Collection|Queue|Deque|ArrayDeque)\b(?:<[^;=]*>)?\s+(\w+)\s*[=;]")],
    "ruby": [("review", "nonatomic_rmw", r"(@@\w+)\s*(?:\+|-|\*|/|\|\||&&|<<)=")],
}
DECLARED = {
    "rust": r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*(?:fn|struct|enum|trait|static|const|type)\s+(?:mut\s+)?([A-Za-z_]\w*)",
    "go": r"(?m)^(?:func\s+(?:\([^)]*\)\s*)?|type\s+|var\s+|const\s+)([A-Za-z_]\w*)",
    "javascript": r"(?m)^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?|class|const|let|var)\s+([A-Za-z_$][\w$]*)",
    "typescript": r"(?m)^(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\*?|class|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)",
    "java": r"(?m)^\s*(?:(?:public|protected|private|static|final|abstract|sealed)\s+)*(?:class|interface|enum|record)\s+([A-Za-z_]\w*)",
    "csharp": r"(?m)^\s*(?:(?:public|protected|private|internal|static|sealed|abstract|partial)\s+)*(?:class|interface|enum|record|struct)\s+([A-Za-z_]\w*)",
    "c": r"(?m)^static\s+[\w\s*]*?\b([A-Za-z_]\w*)\s*[(=;]",
    "ruby": r"(?m)^(?:def\s+(?:self\.)?|class\s+|module\s+)([A-Za-z_]\w*[?!]?)",
}
METAPROGRAMMING = ["define_method", "method_missing", "const_get", "instance_variable_get", "class_eval", "instance_eval", "ActiveRecord", "ActiveSupport"]


def language_of(path: Column) -> Column:
    """By the suffix in lower case; NULL for any other."""
    names = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))
    return F.try_element_at(names, F.regexp_extract(F.lower(path), r"\.(\w+)$", 1))


def code(text: Column, language: Column) -> Column:
    """The text with a space for each comment and string."""
    return F.when(language.isin(*SLASHES), F.regexp_replace(text, SLASH_NOISE, " ")).otherwise(F.regexp_replace(text, HASH_NOISE, " "))


def _by_language(language: Column, rules: dict[str, str], make) -> Column:
    out = F.lit(None)
    for name, rule in rules.items():
        out = F.when(language == name, make(rule)).otherwise(out)
    return out


def decisions(text: Column, language: Column) -> Column:
    """The number of branches and arms."""
    body = code(text, language)
    return _by_language(language, DECISIONS, lambda rule: F.regexp_count(body, F.lit(rule)).cast("long"))


def escapes(text: Column, language: Column) -> Column:
    """The number of names that opt out of types, but in imports, and of comments that begin with an ignore."""
    body = F.regexp_replace(code(text, language), IMPORTS, " ")
    ignored = F.regexp_count(text, F.lit(r"(?://|/\*)\s?@ts-ignore|# type: ignore"))
    return _by_language(language, ESCAPES, lambda rule: (F.regexp_count(body, F.lit(rule)) + ignored).cast("long"))


def surface(text: Column, language: Column) -> Column:
    """ARRAY<STRUCT<severity, kind, name>> of shared state; NULL where the language has no rule."""
    body = code(text, language)

    def one(severity: str, kind: str, rule: str) -> Column:
        return F.transform(F.regexp_extract_all(body, F.lit(rule), 1), lambda n: F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), n.alias("name")))

    def found(rules: list[tuple[str, str, str]]) -> Column:
        return F.concat(*(one(*rule) for rule in rules))

    out = F.lit(None).cast("array<struct<severity:string,kind:string,name:string>>")
    for name, rules in SURFACE.items():
        mine = found(rules) if name != "ruby" else F.when(body.rlike(r"\bThread\b"), found(rules)).otherwise(F.array().cast("array<struct<severity:string,kind:string,name:string>>"))
        out = F.when(language == name, mine).otherwise(out)
    return out


def declared(text: Column, language: Column) -> Column:
    """The names that a file declares, of the kinds that its language's dead code is told by."""
    body = code(text, language)
    out = F.lit(None).cast("array<string>")
    for name, rule in DECLARED.items():
        out = F.when(language == name, F.regexp_extract_all(body, F.lit(rule), 1)).otherwise(out)
    return out


def refused(text: Column, language: Column) -> Column:
    """Why names of a file say nothing about dead code: metaprogramming in Ruby, names pasted together in C; NULL if they do."""
    meta = F.lit(False)
    for word in METAPROGRAMMING:
        meta = meta | text.contains(word)
    return F.when((language == "ruby") & meta, "metaprogramming").when((language == "c") & text.contains("##"), "token pasting")
