"""Definitions in JavaScript, TypeScript, Java, Go and Rust sources, found without a grammar.

What strings, comments, templates and regular expressions hold is blanked, place by place, brackets are paired, and then
declarations are read from what is left, with their ends from the pairs.  A definition is
(start, end, kind, function, class, body), where body is the place of the bracket that opens a container's members.
Each source is read once from left to right; three or more faults (unterminated literals, brackets without a partner) make it unreadable.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

LANGUAGES = ("javascript", "typescript", "java", "go", "rust")
FAULTS = 3

_STOP = {"javascript": r"[\"'`/}{]", "typescript": r"[\"'`/}{]", "java": r"[\"'/]", "go": r"[\"'`/]", "rust": r"[\"'/]|\bb?r#*\""}
_STOP = {k: re.compile(v) for k, v in _STOP.items()}
_PLAIN = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*", re.S) for q in "\"'"}
_LONG = re.compile(r'(?:[^"\\]|\\.)*', re.S)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_REGEX = re.compile(r"(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/")
_BEFORE_REGEX = re.compile(r"(?:^|[=(,:\[!&|?{};+\-*%~^<>]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do|await|yield))\s*\Z")
_RUST_CHAR = re.compile(r"'(?:\\[^\n]*?|[^'\\\n])'")
_BRACKET = re.compile(r"[(){}\[\]]")
_SPACE = re.compile(r"\s*")


def blanked(source: str, language: str) -> tuple[str, int]:
    """The source with blanks for what literals and comments hold, of the same length and lines; and the number of faults."""
    out: list[str] = []
    at, faults, depth = 0, 0, [0]  # open braces in each template that is open
    script = language in ("javascript", "typescript")

    def blank(to: int, keep: int = 0) -> None:
        """Blanks up to a place, but for so many marks at both ends."""
        nonlocal at
        held = source[at:to]
        inner = held[keep : len(held) - keep] if len(held) >= 2 * keep else ""
        out.append(held[:keep] + re.sub(r"[^\n]", " ", inner) + (held[len(held) - keep :] if keep and len(held) > keep else ""))
        at = to

    def template() -> None:
        nonlocal faults, at
        end = _TEMPLATE.match(source, at).end()
        blank(end)
        if source.startswith("${", end):
            depth.append(0)
            out.append("  ")
            at = end + 2
        elif end < len(source):
            out.append("`")
            at = end + 1
        else:
            faults += 1

    while m := _STOP[language].search(source, at):
        out.append(source[at : m.start()])
        at, mark = m.start(), m.group()
        if mark == "/":
            if source.startswith("//", at):
                end = source.find("\n", at)
                blank(len(source) if end < 0 else end)
            elif source.startswith("/*", at):
                end, level = at + 2, 1
                while level:
                    close, again = source.find("*/", end), source.find("/*", end) if language == "rust" else -1
                    if close < 0:
                        faults, end = faults + 1, len(source)
                        break
                    level, end = (level + 1, again + 2) if 0 <= again < close else (level - 1, close + 2)
                blank(end)
            elif script and (r := _REGEX.match(source, at + 1)) and _BEFORE_REGEX.search("".join(out[-3:])[-40:]):
                blank(r.end())
            else:
                out.append("/")
                at += 1
        elif mark in "{}":
            depth[-1] += 1 if mark == "{" else -1
            if depth[-1] < 0 and len(depth) > 1:  # an expression in a template ends
                depth.pop()
                out.append(" ")
                at += 1
                template()
            else:
                out.append(mark)
                at += 1
        elif mark == "`":
            if language == "go":
                end = source.find("`", at + 1)
                faults += end < 0
                blank(len(source) if end < 0 else end + 1, 1)
            else:
                out.append("`")
                at += 1
                template()
        elif mark[-1] == '"' and len(mark) > 1:  # raw
            close = '"' + "#" * mark.count("#")
            end = source.find(close, at + len(mark))
            faults += end < 0
            blank(len(source) if end < 0 else end + len(close))
        elif language == "java" and source.startswith('"""', at):
            end = at + 3
            while (end := source.find('"""', end)) > 0 and source[end - 1] == "\\":
                end += 1
            faults += end < 0
            blank(len(source) if end < 0 else end + 3)
        elif language == "rust" and mark == "'":
            r = _RUST_CHAR.match(source, at)
            if r:
                blank(r.end(), 1)
            else:  # a lifetime
                out.append("'")
                at += 1
        else:
            end = (_LONG if language == "rust" else _PLAIN[mark]).match(source, at + 1).end()
            good = source.startswith(mark, end)
            faults += not good
            blank(end + good, 1)
    out.append(source[at:])
    return "".join(out), faults + len(depth) - 1


def paired(code: str) -> tuple[dict[int, int], int]:
    """The place of each opening bracket's partner, and how many have none."""
    pairs, held, faults = {}, [], 0
    for m in _BRACKET.finditer(code):
        if m.group() in "([{":
            held.append(m.start())
        elif held and code[held[-1]] + m.group() in ("()", "[]", "{}"):
            pairs[held.pop()] = m.start()
        else:
            faults += 1
    for k in held:
        pairs[k] = len(code) - 1
    return pairs, faults + len(held)


class _Reader:
    def __init__(self, code: str, pairs: dict[int, int], language: str):
        self.code, self.pairs, self.typed = code, pairs, language == "typescript"
        self.lead: dict[int, int] = {}  # what follows a decorator: where its decorators begin
        if language in ("javascript", "typescript"):
            for m in re.finditer(r"@[\w$.]+", code):
                after = self.skip(self.past(m.end()))
                self.lead[after] = self.lead.get(m.start(), m.start())

    def skip(self, at: int) -> int:
        return _SPACE.match(self.code, at).end()

    def past(self, at: int) -> int:
        """After the round brackets that open here, if they do."""
        k = self.skip(at)
        return self.pairs[k] + 1 if self.code.startswith("(", k) else at

    def stop(self, at: int, to: int, marks: str) -> int:
        """The first of the marks outside of brackets, or `to`; an opening bracket that is a mark is one."""
        for_brackets = re.compile(f"[{re.escape(marks)}({{\\[]")
        while (m := for_brackets.search(self.code, at, to)) and m.group() not in marks:
            at = self.pairs[m.start()] + 1
        return m.start() if m else to

    TYPE_BRACE = re.compile(r"(?:[<:|&,]|=>|\b(?:is|extends|keyof|readonly))\s*\Z")

    def block(self, at: int, to: int, marks: str = "{;") -> int:
        """The first of the marks, but for braces that belong to a type."""
        k = self.stop(at, to, marks)
        while k < to and self.code[k] == "{" and self.TYPE_BRACE.search(self.code[max(at, k - 80) : k]):
            k = self.stop(self.pairs[k] + 1, to, marks)
        return k

    # ---- JavaScript and TypeScript

    HEAD = re.compile(
        r"(?<![\w$.#@])(?:(?P<abstract>abstract\s+)?class\b(?:\s+(?!extends\b|implements\b)(?P<class>[\w$]+))?|interface\s+(?P<interface>[\w$]+)(?=[\s<{])"
        r"|(?:const\s+)?enum\s+(?P<enum>[\w$]+)(?=\s*\{)|type\s+(?P<type>[\w$]+)\s*(?:<[^=;{]*>)?\s*=(?!=)|(?:async\s+)?function\b\s*(?P<star>\*)?\s*(?P<function>[\w$]+)?(?=\s*[<(])|(?P<method>[\w$]+)(?=\s*\())"
    )
    BODY = re.compile(r"[^;{(\n]*\s*\{")
    NOT_NAMES = frozenset("if for while switch catch with function return typeof new await super import".split())
    OPERATOR = re.compile(r"(?:[=(,:?&|\[!+\-*/<>~^%.]|\b(?:return|new|typeof|void|await|yield|in|of|case|throw|extends))\s*\Z")
    EXPORT = re.compile(r"export\s+(?:default\s+)?(?:declare\s+)?\Z")
    MEMBER = re.compile(r"(?P<modifiers>(?:(?:public|private|protected|static|async|readonly|override|abstract|declare|accessor|get|set)\s+(?=[\w$#\[*\"'@{]))*)(?:\*\s*)?(?P<name>#?[\w$]+|[\"'][^\"'\n]*[\"'])?")

    def script(self, at: int, to: int, owner: str | None) -> Iterator[tuple]:
        while m := self.HEAD.search(self.code, at, to):
            start, at, kind = m.start(), m.end(), m.lastgroup if m.lastgroup != "star" else "function"
            kind = kind if m[kind] and kind != "abstract" else "class" if "class" in m.group() else "function"
            before = self.code[max(0, start - 80) : start]
            if kind == "method":
                opened = self.skip(self.past(at))
                if m["method"] not in self.NOT_NAMES and before.rstrip()[-1:] in ("{", ",") and self.code.startswith("{", opened):
                    at = self.pairs[opened] + 1
                    yield start, at, "method_definition", m["method"], owner, None
                continue
            if self.OPERATOR.search(before) or (kind == "function" and (m["star"] or not m["function"])):
                continue  # expressions and generators are no definitions, but may hold some
            exported = self.EXPORT.search(before)
            start = start - len(exported.group()) if exported else start
            start = self.lead.get(start, start)
            if kind == "type":
                end = self.stop(at, to, ";\n")
                while end < to and self.code[end] == "\n" and (self.code[:end].rstrip()[-1:] in ("|", "&", "=") or self.code[self.skip(end) : self.skip(end) + 1] in ("|", "&")):
                    end = self.stop(self.skip(end) + 1, to, ";\n")
                at = end + (end < to and self.code[end] == ";")
                if self.typed:
                    yield start, at, "type_alias_declaration", None, m["type"], None
                continue
            body = self.block(self.past(self.stop(at, to, "(")), to) if kind == "function" else self.block(at, to)
            if body >= to or self.code[body] == ";":
                continue
            end = self.pairs[body] + 1
            if kind == "function":
                yield start, end, "function_declaration", m["function"], owner, None
            elif kind == "class":
                abstract = bool(m["abstract"]) or not m["class"]
                members = list(self.members(body + 1, end - 1, None if abstract else m["class"]))
                if not abstract:
                    yield start, end, "class_declaration", None, m["class"], (body, members)
                else:
                    yield from members
            elif self.typed:
                yield start, end, f"{kind}_declaration", None, m[kind], None
            at = end

    def members(self, at: int, to: int, owner: str | None) -> Iterator[tuple]:
        while (at := self.skip(at)) < to:
            start = at
            while self.code.startswith("@", at):
                at = self.skip(self.past(re.compile(r"@[\w$.]*").match(self.code, at).end()))
            m = self.MEMBER.match(self.code, at, to)
            name, after = m["name"], self.skip(m.end())
            if name is None and self.code.startswith("[", after):
                name, after = self.code[after : self.pairs[after] + 1], self.skip(self.pairs[after] + 1)
            if self.code.startswith(("?", "!"), after):
                after = self.skip(after + 1)
            if self.code.startswith("<", after) and (g := re.compile(r"<[^(){};]*>").match(self.code, after)):
                after = self.skip(g.end())
            if name is not None and self.code.startswith("(", after):
                k = self.skip(self.pairs[after] + 1)
                body = self.block(k, to, "{;" if self.BODY.match(self.code, k) else "{;\n")
                at = self.pairs[body] + 1 if body < to and self.code[body] == "{" else body + 1
                if body < to and self.code[body] == "{" and "abstract" not in m["modifiers"]:
                    yield start, at, "method_definition", name, owner, None
            elif name is not None:
                end = self.stop(after, to, ";\n")
                while end < to and self.code[end] == "\n" and (self.code[after:end].rstrip()[-1:] in ("=", ",", "|", "&", ":", ">", "?", "+") or self.code[self.skip(end) : self.skip(end) + 1] in ("|", "&", ".", "=", "?", ":")):
                    end = self.stop(self.skip(end) + 1, to, ";\n")
                if self.typed:
                    yield start, start + len(self.code[start:end].rstrip()), "property", name, owner, None
                else:
                    yield from self.script(after, end, owner)
                at = end + 1
            else:  # a static block, or what no member begins with
                at = self.pairs[after] + 1 if after in self.pairs else after + 1

    # ---- Java

    TYPE = re.compile(r"(?<![\w$.@])(class|interface|enum|record)\s+([\w$]+)")
    MODIFIERS = re.compile(r"@[\w$.]+(?:\s*\([^)]*\))?|\b(?:public|private|protected|static|final|abstract|synchronized|native|default)\b")
    NAMED = re.compile(r"([\w$]+)\s*\Z")

    def java(self, at: int, to: int, owner: str | None) -> Iterator[tuple]:
        while (at := self.skip(at)) < to:
            start, end, call = at, at, None
            while True:
                end = self.stop(end, to, ";{=(")
                if end < to and self.code[end] == "(":
                    name = self.NAMED.search(self.code, start, end)
                    if name and not re.search(r"@[\w$.]*\Z", self.code[start : name.start()]) and call is None:
                        call = name
                    end = self.pairs[end] + 1
                    continue
                break
            mark = self.code[end] if end < to else ""
            kind = self.TYPE.search(self.code, start, call.end() if call else end)
            if mark == "=":
                at = self.stop(end, to, ";") + 1
            elif kind and mark == "{":
                at, what = self.pairs[end] + 1, kind[1]
                if what == "enum":
                    yield start, at, "enum_declaration", None, kind[2], None
                else:
                    inner = list(self.java(end + 1, at - 1, kind[2] if what != "record" else owner))
                    if what == "record":
                        yield from inner
                    else:
                        yield start, at, f"{what}_declaration", None, kind[2], (end, inner)
            elif call and (mark == "{" or (mark == ";" and owner)) and "@interface" not in self.code[start:end]:
                at = self.pairs[end] + 1 if mark == "{" else end + 1
                before, n = self.MODIFIERS.sub(" ", self.code[start : call.start()]), 1
                while n:
                    before, n = re.subn(r"<[^<>]*>", " ", before)
                yield start, at, "method_declaration" if before.strip() else "constructor_declaration", call[1], owner, None
            else:
                at = self.pairs[end] + 1 if mark == "{" else end + 1

    # ---- Go

    GO = re.compile(r"^(?:func\b\s*(\()?|type\b)", re.M)

    def go(self, at: int, to: int, owner: str | None) -> Iterator[tuple]:
        while m := self.GO.search(self.code, at, to):
            start = m.start()
            if m.group().startswith("type"):
                end = self.stop(m.end(), to, "\n")
                at = end
                yield start, start + len(self.code[start:end].rstrip()), "type_declaration", None, None, None
                continue
            k = self.pairs[m.end() - 1] + 1 if m[1] else m.end()
            name = re.compile(r"\s*(\w+)").match(self.code, k)
            at = m.end()
            if not name:
                continue
            k = self.past(self.stop(name.end(), to, "("))
            end = self.stop(k, to, "{\n")
            while end < to and self.code[end] == "{" and re.search(r"\b(?:interface|struct)\s*\Z", self.code[k:end]):
                end = self.stop(self.pairs[end] + 1, to, "{\n")
            at = self.pairs[end] + 1 if end < to and self.code[end] == "{" else end
            yield start, start + len(self.code[start:at].rstrip()), "method_declaration" if m[1] else "function_declaration", name[1], owner, None

    # ---- Rust

    RUST = re.compile(r"(?<![\w.'])(?:(?:pub(?:\s*\([^)]*\))?|default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*(?:(?P<kind>fn|struct|enum|trait)\s+(?P<name>\w+)|(?P<impl>impl)\b|(?P<macro>[\w:]+!)\s*\w*\s*(?=[({\[]))")

    def rust(self, at: int, to: int, owner: str | None) -> Iterator[tuple]:
        while m := self.RUST.search(self.code, at, to):
            start, at = m.start(), m.end()
            if m["macro"]:
                at = self.pairs[self.stop(at, to, "({[")] + 1
                continue
            if m["impl"] and self.code[:start].rstrip()[-1:] not in ("", "{", "}", ";", "]"):
                continue
            kind = m["kind"] or "impl"
            body = self.stop(at, to, "{;")
            block = body < to and self.code[body] == "{"
            end = self.pairs[body] + 1 if block else min(to, body + 1)
            at = end
            if kind == "fn" and block:
                yield start, end, "function_item", m["name"], owner, None
            elif kind in ("struct", "enum", "trait"):
                yield start, end, f"{kind}_item", None, m["name"], None
            elif kind == "impl" and block:
                head = self.code[m.end() : body]
                if head.startswith("<"):  # its own parameters
                    depth = 0
                    for k, c in enumerate(head):
                        depth += (c == "<") - (c == ">" and head[k - 1] != "-")
                        if not depth:
                            head = head[k + 1 :]
                            break
                name = re.split(r"\bwhere\b", re.split(r"\bfor\b(?!\s*<)", head)[-1])[0].strip()
                yield start, end, "impl_item", None, name, (body, list(self.rust(body + 1, end - 1, name)))


def definitions(source: str, language: str) -> list[tuple] | None:
    """Top definitions in order, containers with their members; None for a source that cannot be read."""
    code, faults = blanked(source, language)
    pairs, more = paired(code)
    if faults + more >= FAULTS:
        return None
    reader = _Reader(code, pairs, language)
    return list({"java": reader.java, "go": reader.go, "rust": reader.rust}.get(language, reader.script)(0, len(code), None))


def definition_rows(source: str, language: str) -> list[tuple] | None:
    """(content, first line, last line, kind, function, class, docstring, strategy), as of chunks; None if nothing is defined or the source cannot be read."""
    from bisect import bisect_right

    found = definitions(source, language)
    if not found:
        return None
    breaks = [m.start() for m in re.finditer("\n", source)]
    line = lambda at: bisect_right(breaks, at - 1) + 1
    rows: list[tuple] = []

    def add(start: int, end: int, kind: str, function: str | None, owner: str | None, inside: tuple | None) -> None:
        if not inside or not inside[1]:
            rows.append((source[start:end], line(start), line(end - 1), kind, function, owner, None, "ast"))
            return
        body, members = inside
        rows.append((source[start:body].strip(), line(start), min(line(end - 1), max(line(start), line(members[0][0]) - 1)), kind, None, owner, None, "ast"))
        for m in members:
            add(*m)

    for d in found:
        add(*d)
    return rows
