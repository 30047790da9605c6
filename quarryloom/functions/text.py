"""Text expressions: paths, languages, names, query understanding, tokens.  All are Columns of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and their languages.
EXTENSION_LANGUAGE = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java",
    "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp", "rb": "ruby", "php": "php", "cs": "csharp", "swift": "swift", "md": "markdown", "json": "json",
    "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "css": "css",
}
# Directories that are never indexed.
IGNORED_DIRS = (".git", "node_modules", "venv", "dist", "build", "vendor")
# Aliases that the chunker accepts.
CHUNK_LANGUAGE = {
    "py": "python", "python": "python", "js": "javascript", "javascript": "javascript", "jsx": "javascript", "ts": "typescript", "typescript": "typescript",
    "tsx": "typescript", "go": "go", "golang": "go", "rs": "rust", "rust": "rust", "java": "java", "c": "c", "cpp": "cpp", "c++": "cpp",
}
# Words that are no keywords.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "code", "do", "does", "for", "from", "get", "give", "how", "i", "in", "into", "is", "it",
    "me", "method", "of", "on", "please", "show", "that", "the", "this", "to", "what", "where", "which", "with",
)
# Extensions of paths named in a query.
PATH_EXTENSIONS = (
    "py", "js", "jsx", "ts", "tsx", "java", "kt", "kts", "go", "rs", "cpp", "cc", "cxx", "c", "h", "hpp", "cs", "php", "rb", "swift", "scala", "sql",
    "html", "css", "scss", "sass", "vue", "svelte", "json", "yaml", "yml", "xml", "toml", "ini", "env",
)
# Names of languages in queries.
LANGUAGE_HINTS = {
    "python": "python", "py": "python", "javascript": "javascript", "js": "javascript", "typescript": "typescript", "ts": "typescript", "java": "java",
    "kotlin": "kotlin", "go": "go", "golang": "go", "rust": "rust", "c++": "cpp", "cpp": "cpp", "c#": "csharp", "csharp": "csharp", "php": "php",
    "ruby": "ruby", "swift": "swift", "scala": "scala",
}
# Phrases that tell an intent; security phrases win over all others.
INTENT_PHRASES = {
    "RETRIEVE": ("find", "get", "retrieve", "show", "locate", "search", "list", "where", "identify", "fetch"),
    "ADD_FEATURE": ("add", "create", "implement", "introduce", "support", "new feature"),
    "FIX_BUG": ("fix", "bug", "error", "issue", "debug", "broken", "not working"),
    "OPTIMIZE": ("optimize", "optimise", "optimization", "optimisation", "improve performance", "speed up", "faster", "performance"),
    "REFACTOR": ("refactor", "refactoring", "restructure", "clean up", "cleanup", "reorganize", "reorganise"),
}
SECURITY = r"vulnerab[\p{L}\p{N}_]*|audit|cve|security\s+(?:vulnerability|issue|flaw|audit|fix)|package\.json\s+vulnerability|package\s+vulnerability"
# Code words that are split off longer identifiers.
CODE_PARTS = (
    "process", "status", "file", "user", "record", "service", "controller", "repository", "repo", "create", "update", "delete", "remove", "reset", "clear",
    "get", "set", "find", "save", "upload", "download", "validate", "check", "handle", "add",
)
# Lexicons of bug reports.
BUG_STOP_WORDS = (
    "a", "an", "and", "are", "at", "be", "bug", "by", "for", "from", "fix", "in", "is", "it", "of", "on", "or", "please", "the", "to", "with", "when",
    "where", "which", "why", "how", "issue", "problem",
)
BUG_ACTIONS = (
    "add", "calculate", "change", "choose", "create", "delete", "fetch", "get", "load", "parse", "remove", "save", "select", "selection", "set", "submit",
    "update", "validate", "render", "show", "hide", "open", "close",
)
BUG_ERRORS = (
    "broken", "cannot", "crash", "doesnt", "empty", "error", "fail", "fails", "failed", "failure", "incorrect", "invalid", "missing", "never", "not",
    "rejected", "wrong", "unexpected", "unavailable",
)
BUG_FIELDS = (
    "date", "time", "status", "id", "name", "email", "address", "value", "type", "state", "count", "amount", "price", "password", "token", "path", "url",
    "selection", "selected",
)

#: What Python's \w is for letters and digits.
WORD = r"[\p{L}\p{N}_]"
FIRST = 10


def lookup(table: dict[str, str], key: Column) -> Column:
    """The key's value in a small constant table, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def language_of(path: Column) -> Column:
    """The language of a path's last suffix; null for others."""
    return lookup(EXTENSION_LANGUAGE, F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1)))


def chunk_language(name: Column) -> Column:
    """Canonical name of an alias or of a dotted extension; others as they are, lower-cased and without their dots."""
    clean = F.lower(F.trim(name))
    bare = F.regexp_replace(clean, r"^\.+", "")
    dotted = F.coalesce(F.when(clean == F.concat(F.lit("."), bare), lookup(EXTENSION_LANGUAGE, bare)), bare)
    return F.when(clean != "", F.when(clean.startswith("."), dotted).otherwise(F.coalesce(lookup(CHUNK_LANGUAGE, clean), clean)))


def is_source_file(path: Column) -> Column:
    """No hidden or ignored segment, and a known language."""
    parts = F.split(path, "/")
    return ~F.exists(parts, lambda p: p.startswith(".") | p.isin(*IGNORED_DIRS)) & language_of(path).isNotNull()


def collection_name(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), "-./:", "____")


def source_collection(kind: Column, location: Column) -> Column:
    """The collection that a source's location stands for; null where the location is not valid."""
    clean = lambda x: F.translate(F.lower(F.trim(x)), "-./", "___")
    place = F.trim(location)
    owner, repo = (F.regexp_extract(place, r"^(?i:https?)://(?i:github\.com)/+([^/?#]+)/+([^/?#]+?)/*(?:[?#].*)?$", k) for k in (1, 2))
    repo = F.regexp_replace(repo, r"(?i)\.git$", "")
    stem = F.regexp_extract(F.element_at(F.split(F.regexp_replace(place, "/+$", ""), "/"), -1), r"(?i)^(.*)\.zip$", 1)
    git = F.when((owner != "") & (repo != ""), F.concat(F.lit("repo_"), clean(owner), F.lit("_"), clean(repo)))
    return F.when(kind == "git", git).when((kind == "zip") & (clean(stem) != ""), F.concat(F.lit("repo_local_"), clean(stem)))


def github_parts(url: Column) -> Column:
    """struct(owner, name) of a GitHub URL, with or without `.git` and a final slash; null fields if it is none."""
    pattern = r"^https://github\.com/([A-Za-z0-9_.\-]+)/([A-Za-z0-9_.\-]+?)(?:\.git)?/?$"
    part = lambda k: F.nullif(F.regexp_extract(F.trim(url), pattern, k), F.lit(""))
    return F.struct(part(1).alias("owner"), part(2).alias("name"))


def is_branch_name(name: Column) -> Column:
    return F.trim(name).rlike(r"^[A-Za-z0-9._/\-]+$")


def sanitised_query(query: Column, most: int = 2000) -> Column:
    """The trimmed query; null if it is longer than `most`."""
    q = F.trim(query)
    return F.when(F.length(q) <= most, q)


def distinct_ci(values: Column, most: int | None = None) -> Column:
    """The first of each set of values that differ in case alone, in order; the first `most` of these.

    The values and their lower-cased form are bound once through one-element arrays, as they would be made anew for each value within a lambda.
    """

    def firsts(both: Column) -> Column:
        found = F.array_distinct(F.array_compact(both["lowered"]))
        found = found if most is None else F.slice(found, 1, most)
        return F.transform(found, lambda x: F.element_at(both["values"], F.array_position(both["lowered"], x).cast("int")))

    bound = F.transform(F.array(values), lambda v: F.struct(v.alias("values"), F.transform(v, F.lower).alias("lowered")))
    return F.element_at(F.transform(bound, firsts), 1)


def unique_terms(values: Column, most: int | None = None) -> Column:
    """Trimmed, not blank, distinct without regard to case; the first `most` of these."""
    trimmed = F.transform(values, lambda x: F.trim(x))  # noqa: PLW0108  # F.trim itself would take the place in the array as what to trim off
    return distinct_ci(F.filter(trimmed, lambda x: x != ""), most)


def names(text: Column) -> Column:
    """All [A-Za-z_][A-Za-z0-9_]* that are whole words: the words that hold no other letters."""
    return F.filter(F.regexp_extract_all(text, F.lit(WORD + "+"), F.lit(0)), lambda w: w.rlike("^[A-Za-z_][A-Za-z0-9_]*$"))


def keywords(query: Column) -> Column:
    kept = F.filter(names(query), lambda w: ~F.lower(w).isin(*STOP_WORDS) & (F.length(w) >= 2))
    return distinct_ci(kept, FIRST)


def identifiers(query: Column) -> Column:
    """Names in camel, Pascal or snake case, or with a digit."""
    looks = lambda w: w.rlike("[a-z][A-Z]") | w.rlike("^[^_].*_") | (w.rlike("[A-Za-z]") & w.rlike("[0-9]")) | w.rlike("^[A-Z][a-z]+(?:[A-Z][A-Za-z0-9]*)+$")
    return distinct_ci(F.filter(names(query), looks), FIRST)


def file_paths(query: Column) -> Column:
    pattern = rf"(?i)(?<![\p{{L}}\p{{N}}_.\-])(?:[A-Za-z0-9_.\-]+/)*[A-Za-z0-9_.\-]+\.(?:{'|'.join(PATH_EXTENSIONS)})(?![\p{{L}}\p{{N}}_.\-])"
    return distinct_ci(F.regexp_extract_all(query, F.lit(pattern), F.lit(0)), FIRST)


def repository_hint(query: Column) -> Column:
    pattern = rf"(?i)(?<!{WORD})(?:repository|repo)\s*[:=]?\s*([A-Za-z0-9_.\-]+(?:/[A-Za-z0-9_.\-]+)?)(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
    return F.nullif(F.regexp_extract(query, pattern, 1), F.lit(""))


def language_hint(query: Column) -> Column:
    """The longest language name in the query that no letter, digit, + or # touches."""
    lowered = F.lower(query)
    longest = sorted(LANGUAGE_HINTS.items(), key=lambda p: -len(p[0]))
    return F.coalesce(*[F.when(lowered.rlike(rf"(?<![a-z0-9+#]){alias.replace('+', '[+]')}(?![a-z0-9+#])"), F.lit(name)) for alias, name in longest])


def intent(query: Column) -> Column:
    """The one intent whose phrases occur; null if none or several do."""
    q = F.lower(F.trim(query))
    has = lambda body: q.rlike(rf"(?<!{WORD})(?:{body})(?!{WORD})")
    found = F.filter(F.array(*[F.when(has("|".join(p)), F.lit(name)) for name, p in INTENT_PHRASES.items()]), lambda x: x.isNotNull())
    return F.when(has(SECURITY), F.lit("FIX_VULNERABILITY")).when(F.size(found) == 1, F.element_at(found, 1))


def _spaced(text: Column) -> Column:
    """Lower-cased words between single blanks, after acronyms and camel case were split; single characters are left out."""
    split = F.regexp_replace(F.coalesce(text, F.lit("")), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    split = F.regexp_replace(split, "([a-z0-9])([A-Z])", "$1 $2")
    # words are taken, as putting a blank for what is between them costs several times as much
    return F.lower(F.array_join(F.regexp_extract_all(split, F.lit("[a-zA-Z0-9]{2,}"), F.lit(0)), " "))


def _split(spaced: Column) -> Column:
    return F.when(spaced == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(spaced, " "))


def code_words(text: Column) -> Column:
    """Lower-cased words of more than one character, after acronyms and camel case were split."""
    return F.element_at(F.transform(F.array(_spaced(text)), _split), 1)


def code_tokens(text: Column) -> Column:
    """Words, then each code word that some longer identifier holds before the word itself occurs.

    This closed form has the same multiset of tokens as adding sub-words while walking the words, in linear time: the first
    place of a code word lies in the first word that holds it, so it is added unless that word is the code word itself.
    """

    def tokens(spaced: Column) -> Column:
        return F.concat(_split(spaced), F.element_at(F.transform(F.array(F.concat(F.lit(" "), spaced, F.lit(" "))), parts_of), 1))

    def parts_of(padded: Column) -> Column:
        alone = lambda p: F.instr(padded, p) == F.instr(padded, F.concat(F.lit(" "), p, F.lit(" "))) + 1
        return F.filter(F.array(*map(F.lit, CODE_PARTS)), lambda p: padded.contains(p) & ~alone(p))  # one expression for all code words keeps plans small

    # bound once through one-element arrays
    return F.element_at(F.transform(F.array(_spaced(text)), tokens), 1)


def simple_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), F.lit("[A-Za-z][A-Za-z0-9]*"), F.lit(0)), F.lower)


def search_terms(query: Column, most: int = 12) -> Column:
    """Distinct tokens of identifiers, keywords and the query itself, in that order."""
    return terms_of(identifiers(query), keywords(query), query, most)


def terms_of(identifiers: Column, keywords: Column, query: Column, most: int = 12) -> Column:
    texts = F.concat(identifiers, keywords, F.array(query))
    return F.slice(F.array_distinct(F.flatten(F.transform(texts, code_tokens))), 1, most)


def bug_signals(query: Column) -> Column:
    """struct(entities, fields, actions, errors): distinct tokens by lexicon."""
    terms = simple_tokens(query)
    of = lambda words: distinct_ci(F.filter(terms, lambda t: t.isin(*words)))
    known = (*BUG_STOP_WORDS, *BUG_ACTIONS, *BUG_ERRORS, *BUG_FIELDS)
    entities = distinct_ci(F.filter(terms, lambda t: ~t.isin(*known) & (F.length(t) > 2)))
    return F.struct(entities.alias("entities"), of(BUG_FIELDS).alias("fields"), of(BUG_ACTIONS).alias("actions"), of(BUG_ERRORS).alias("errors"))


def is_vulnerability_query(query: Column) -> Column:
    q = F.lower(F.coalesce(query, F.lit("")))
    return q.contains("package.json") | q.contains("vulnerab") | q.contains("audit") | (q.contains("package") & (q.contains("fix") | q.contains("update") | q.contains("patch")))


def contains_word(text: Column, word: Column) -> Column:
    """Whether the literal word occurs in the text with no word character around it, in any case."""
    escaped = F.regexp_replace(word, r"([^\p{L}\p{N}_\s])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(rf"(?iu)(?<!{WORD})"), escaped, F.lit(rf"(?!{WORD})")))


def paths_match(a: Column, b: Column) -> Column:
    """Equal, one a suffix of the other, or equal file names where one has no directory."""
    x, y = (F.regexp_replace(F.lower(F.translate(p, "\\", "/")), "^/+|/+$", "") for p in (a, b))
    base = lambda p: F.element_at(F.split(p, "/"), -1)
    return (x != "") & (y != "") & ((x == y) | x.endswith(F.concat(F.lit("/"), y)) | y.endswith(F.concat(F.lit("/"), x)) | ((base(x) == base(y)) & (~x.contains("/") | ~y.contains("/"))))


def token_estimate(text: Column) -> Column:
    """A quarter of the length, at least one for a text that is not empty."""
    n = F.length(text)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("int")


def truncated(text: Column, most: int, marker: str = "\n... [truncated]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(marker))).otherwise(text)


def is_binary(content: Column) -> Column:
    """A NUL among the first 8192 bytes."""
    return F.instr(F.substring(content, 1, 8192).cast("string"), "\0") > 0


def decoded(content: Column) -> Column:
    """UTF-8 text without the bytes that do not decode (a replacement character in the input goes as well)."""
    return F.translate(F.make_valid_utf8(content.cast("string")), "�", "")
