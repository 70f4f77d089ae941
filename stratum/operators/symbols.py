"""Symbols of source files: functions, classes, methods, parameters, imports, exports and calls, by a pluggable extractor.

The extractor here first blanks comments and the insides of strings, by the states of each language's lexer, and pairs
brackets; so what a pattern finds is code, and a block ends at its own bracket.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions import paths

Symbol = tuple[str, str, str, int, int]  # kind, name, owner, first and last line
Extractor = Callable[[str, str], list[Symbol]]
SCHEMA = "file_path string, kind string, name string, owner string, start_line int, end_line int, ord int"
KEYWORDS = set("if for while switch catch return function super typeof sizeof elif def class func fn match new await in not and or with assert print".split())
NAME = r"[A-Za-z_$][\w$]*"
FAMILY = {"typescript": "javascript", "tsx": "javascript", "javascript": "javascript", "python": "python", "go": "go", "rust": "rust", "java": "java", "c": "c", "cpp": "c"}

LINE, BLOCK = r"(?P<note>//[^\n]*)", r"(?P<block>/\*)"
QUOTED = r'(?P<text>"(?:\\.|[^"\\\n])*"?)'
SINGLE = r"(?P<single>(?<!\w)'(?:\\.|[^'\\\n])*'?)"
TRIPLE = r'(?P<triple>"""(?:\\.|.)*?(?:"""|\Z))'
#: By family: what a comment or a string begins with, and where it can be said at once, all of it.
LEXERS = {
    "javascript": "|".join((LINE, BLOCK, QUOTED, r"(?P<single>'(?:\\.|[^'\\\n])*'?)", r"(?P<template>`)", r"(?P<pattern>(?:(?<=[(,=:\[!&|?{};\n])[ \t]*|(?<=\breturn)[ \t]+)/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/)", r"(?P<brace>[{}])")),
    "python": "|".join((r"(?P<note>#[^\n]*)", TRIPLE, r"(?P<triples>'''(?:\\.|.)*?(?:'''|\Z))", QUOTED, r"(?P<single>'(?:\\.|[^'\\\n])*'?)")),
    "go": "|".join((LINE, BLOCK, QUOTED, SINGLE, r"(?P<raw>`[^`]*`?)")),
    "rust": "|".join((LINE, BLOCK, r'(?P<raw>(?<!\w)b?r(?P<hashes>#*)".*?(?:"(?P=hashes)|\Z))', QUOTED, r"(?P<single>'(?:\\[^\n]+?|[^'\\\n])')")),
    "java": "|".join((LINE, BLOCK, TRIPLE, QUOTED, SINGLE)),
    "c": "|".join((LINE, BLOCK, r'(?P<raw>(?<!\w)(?:u8|[uUL])?R"(?P<mark>[^()\\\s]{0,16})\(.*?(?:\)(?P=mark)"|\Z))', QUOTED, SINGLE)),
}
LEXERS_C = {k: re.compile(v, re.S) for k, v in LEXERS.items()}
TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
NESTED, PLAIN = re.compile(r"/\*|\*/"), re.compile(r"\*/")
OPEN, CLOSE = "([{", ")]}"

#: By family: (kind, how its line begins up to the name, what must follow its parameters). A kind of none only owns what is within.
MODS = r"(?:(?:public|private|protected|static|final|abstract|synchronized|default|native|async|get|set|readonly|override)\s+)"
VISIBLE = r"(?:pub(?:\([^)]*\))?\s+)?"
BRACES = [
    ("function", rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{NAME})\s*(?=[(<])", None),
    ("function", rf"(?:export\s+)?(?:const|let|var)\s+(?P<name>{NAME})\s*(?::[^=\n]+)?=\s*(?:async\s*)?function\b[^(\n]*(?=\()", None),
    ("function", rf"(?:export\s+)?(?:const|let|var)\s+(?P<name>{NAME})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:<[^>\n]*>)?(?=\()", r"\s*(?::[^=;]*?)?=>"),
    ("function", rf"(?:export\s+)?(?:const|let|var)\s+(?P<name>{NAME})\s*=\s*(?:async\s+)?(?P<only>{NAME})\s*=>", None),
    ("class", rf"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>{NAME})", None),
    ("method", rf"(?<=\s){MODS}*[*#]?(?P<name>{NAME})\s*(?:<[^>\n(]*>)?(?=\()", r"\s*(?::[^;{}=]+)?\{"),
]
RULES = {
    "javascript": BRACES,
    "python": [("function", rf"(?:async\s+)?def\s+(?P<name>{NAME})\s*(?=[(\[])", None), ("class", rf"class\s+(?P<name>{NAME})", None)],
    "go": [("method", rf"func\s+\([^)]*?(?P<owner>{NAME})(?:\[[^\]]*\])?\)\s*(?P<name>{NAME})\s*(?=\()", None), ("function", rf"func\s+(?P<name>{NAME})\s*(?=[(\[])", None), ("class", rf"type\s+(?P<name>{NAME})\s*(?:\[[^\]\n]*\])?\s+(?:struct|interface)\b", None)],
    "rust": [("function", rf"{VISIBLE}(?:default\s+)?(?:async\s+|unsafe\s+|const\s+|extern\s+(?:\"\s*\"\s+)?)*fn\s+(?P<name>{NAME})\s*(?=[(<])", None), ("class", rf"{VISIBLE}(?:unsafe\s+)?(?:struct|enum|trait|union)\s+(?P<name>{NAME})", None), ("", rf"(?:unsafe\s+)?impl\b(?:\s*<[^{{\n]*?>)?\s+(?:[^{{\n]*?\bfor\s+)?(?:&\s*)?(?:\w+::)*(?P<name>{NAME})", None)],
    "java": [("class", rf"{MODS}*(?:class|interface|enum|record|@interface)\s+(?P<name>{NAME})", None), ("method", rf"(?:@\w+\s+)*{MODS}*(?:<[^()\n]*>\s*)?(?!(?:return|new|else|throw)\b)[\w.]+(?:<[^()\n=]*>)?(?:\[\])*\s+(?P<name>{NAME})\s*(?=\()", r"\s*(?:throws\s+[\w.,\s]+)?[{;]"), ("method", rf"{MODS}+(?P<name>{NAME})\s*(?=\()", r"\s*(?:throws\s+[\w.,\s]+)?\{")],
    "c": [("class", rf"(?:template\s*<[^\n]*>\s*)?(?:typedef\s+)?(?:struct|class|union|enum(?:\s+class)?)\s+(?P<name>{NAME})(?=\s*(?:final\s*)?[{{:])", None), ("function", rf"(?!(?:return|else|new|delete|goto|case|throw|typedef)\b)(?:[\w:<>,*&~]+[ \t]+)+[*&]*(?:(?P<owner>{NAME})::)?(?P<name>~?{NAME})\s*(?=\()", r"\s*(?:(?:const|noexcept|override|final)\b\s*)*(?:->\s*[\w:<>*& ]+)?(?::[^;{}]*)?\{"), ("function", rf"(?P<owner>{NAME})::(?P<name>~?{NAME})\s*(?=\()", r"\s*(?:noexcept\s*)?(?::[^;{}]*)?\{")],
}
RULES_C = {k: [(kind, re.compile(r"(?:^|(?<=\n))(?P<indent>[ \t]*)" + p), after and re.compile(after)) for kind, p, after in v] for k, v in RULES.items()}
#: Functions and methods of these have parameters; those that the grammars in question name none for have not.
WITHOUT = {("javascript", "method"), ("go", "method")}
IMPORTS = {
    "javascript": [r"""^[ \t]*import\s+(?:(?P<names>[^'";]+?)\s+from\s+)?['"](?P<source>[^'"\n]+)['"]""", rf"""(?:const|let|var)\s+(?P<names>\{{[^}}]*\}}|{NAME})\s*=\s*require\(\s*['"](?P<source>[^'"\n]+)['"]"""],
    "python": [r"^[ \t]*from[ \t]+(?P<source>[.\w]+)[ \t]+import[ \t]+(?P<names>\([^)]*\)|[^#\n;]+)", r"^[ \t]*import[ \t]+(?P<source>[.\w]+)"],
    "go": [r"""^[ \t]*(?:import[ \t]+)?(?:[\w.]+[ \t]+)?"(?P<source>[^"\n]+)"[ \t]*;?[ \t]*$"""],
    "rust": [r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<source>\w+(?:::\w+)*)(?:::\{(?P<names>[^}]*)\})?"],
    "java": [r"^[ \t]*import\s+(?:static\s+)?(?P<source>[\w.]+)"],
    "c": [r"""^[ \t]*#[ \t]*include[ \t]*[<"](?P<source>[^>"\n]+)[>"]"""],
}
IMPORTS_C = {k: [re.compile(p, re.M) for p in v] for k, v in IMPORTS.items()}
#: Families whose imports stand in quotes, which are blank once masked.
SOURCES_QUOTED = {"javascript", "go", "c"}
EXPORT = re.compile(rf"^[ \t]*export\s+(?:default\s+)?(?:declare\s+)?(?:async\s+)?(?:function|class|const|let|var|interface|type|enum|abstract\s+class)\s*\*?\s*(?P<name>{NAME})|^[ \t]*(?:module\.)?exports\.(?P<other>{NAME})\s*=|^[ \t]*export\s*\{{(?P<list>[^}}]*)\}}", re.M)
BLANK = re.compile(r"[ \t]*")
#: Words before a name, and names, that make no call.
DEFINES, NO_CALL = re.compile(r"\b(?:function\s*\*?|fn|def|func|class)\s*$"), KEYWORDS | {"import", "async"}
CALL = re.compile(rf"(?<![\w$])(?P<name>{NAME})(?:(?:::)?<[\w, \[\]]*>)?[ \t]*\(")


def masked(content: str, family: str) -> tuple[str, list[tuple[int, int]]]:
    """The content with comments and the insides of strings blank, at the same places, and the spans of both.

    Code within a template's braces stays code, templates in it are templates again, and comments of rust nest.
    """
    lexer, spans, pos, depths = LEXERS_C[family], [], 0, []
    nests = NESTED if family == "rust" else PLAIN

    def template(at: int) -> int:
        """From within a template to behind its end, or to code in it, which is put on the stack."""
        end = at
        while m := TEMPLATE.search(content, end):
            end = m.end()
            if m[0] == "`":
                spans.append((at, m.start()))
                return end
            if m[0] == "${":
                spans.append((at, m.start()))
                depths.append(0)
                return end
        spans.append((at, len(content)))
        return len(content)

    while m := lexer.search(content, pos):
        kind, a, pos = m.lastgroup, m.start(), m.end()
        if kind == "brace":
            if depths:
                if m[0] == "{":
                    depths[-1] += 1
                elif depths[-1]:
                    depths[-1] -= 1
                else:
                    depths.pop()
                    pos = template(pos)
        elif kind == "template":
            pos = template(pos)
        elif kind == "block":
            depth = 1
            while depth and (e := nests.search(content, pos)):
                pos, depth = e.end(), depth + (1 if e[0] == "/*" else -1)
            pos = len(content) if depth else pos
            spans.append((a, pos))
        elif kind == "note":
            spans.append((a, pos))
        else:
            spans.append((a + 1, max(pos - 1, a + 1) if content[pos - 1] in "'\"`/" else pos))
    out, at = [], 0
    for a, b in spans:
        out += [content[at:a], re.sub(r"[^\n]", " ", content[a:b])]
        at = b
    return "".join((*out, content[at:])), spans


def pairs(code: str) -> dict[int, int]:
    """Where the bracket at each place is closed. One that closes another kind ends what is open within."""
    ends, stack = {}, []
    for m in re.finditer(r"[()\[\]{}]", code):
        c = m[0]
        if c in OPEN:
            stack.append((c, m.start()))
            continue
        want = OPEN[CLOSE.index(c)]
        if any(o == want for o, _ in stack[-8:]):
            while stack[-1][0] != want:
                stack.pop()
            ends[stack.pop()[1]] = m.start()
    return ends


def parameters(text: str, python: bool) -> list[str]:
    """Names of parameters: a list's parts between commas that no bracket holds; in Python up to a type or default, elsewhere the first
    word, or all of what doesn't begin with one."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text + ","):
        depth += (c in "([{<") - (c in ")]}" or (c == ">" and text[i - 1 : i] not in ("=", "-")))
        if c == "," and (depth <= 0 or i == len(text)):
            part = " ".join(text[at:i].split())
            at = i + 1
            part = re.split("[:=]", part)[0].strip() if python else m[0] if (m := re.match(r"\w+", part)) else part
            out += [part] if part else []
    return out


def extract(content: str, language: str) -> list[Symbol]:
    """Symbols by a lexer and patterns of how declarations begin; a stand-in where no parser is installed.

    Declarations come first, then imports, names of imports, exports and calls by line, then parameters (``param``, owned by their function).
    """
    family = FAMILY.get(language)
    if not family:
        return []
    code, spans = masked(content, family)
    ends = pairs(code)
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    line_of = lambda at: bisect_right(starts, at)  # noqa: E731  from 1
    held = [0] * (len(starts) + 2)  # by line, whether it begins within a string or brackets
    for a, b in (*spans, *ends.items()):
        held[line_of(a) + 1] += 1
        held[line_of(b) + 1] -= 1
    for i in range(1, len(held)):
        held[i] += held[i - 1]
    lines = code.split("\n")

    def indented(first: int) -> int:
        """The last line of the block that a line begins, by indent."""
        indent, last = len(lines[first - 1]) - len(lines[first - 1].lstrip()), first
        for n in range(first + 1, len(lines) + 1):
            if held[n] > 0 or lines[n - 1].strip():
                if held[n] <= 0 and len(lines[n - 1]) - len(lines[n - 1].lstrip()) <= indent:
                    break
                last = n
        return last

    stops = re.compile(r"[;{(\[]|=>\s*(?![\s{])")

    def braced(at: int) -> int:
        """The last line of what is declared: that of its block, or of the statement where it has none."""
        arrow = False
        while m := stops.search(code, at):
            c = m[0]
            if c == ";" or (arrow and "\n" in code[at : m.start()]):
                return line_of(at if arrow and "\n" in code[at : m.start()] else m.start())
            if c[0] == "=":
                arrow, at = True, m.end()
                continue
            end = ends.get(m.start(), len(code) - 1)
            if c == "{" and not arrow and not re.match(r"[ \t]*(?:[{]|=>)", code[end + 1 : end + 80]):
                return line_of(end)
            at = end + 1
        return line_of(at) if arrow or at < len(code) else len(starts)

    found, names, params = [], set(), []  # found: kind, name, owner, first and last line
    opened = []  # classes around a line: name, first and last line
    heads = []
    for place, (kind, rule, after) in enumerate(RULES_C[family]):
        for m in rule.finditer(code):
            heads.append((m.start(), place, kind, after, m))
    taken = 0
    for _, _, kind, after, m in sorted(heads, key=lambda h: h[:2]):
        name, at = m["name"], m.end()
        if name in KEYWORDS or m.start("name") < taken:
            continue
        while at < len(code) and code[at] in "<[" and kind in ("function", "method"):  # type parameters
            close = ends.get(at, -1) if code[at] == "[" else code.find(">", at)
            at = close + 1 if close >= 0 else len(code)
            at = BLANK.match(code, at).end()
        close = ends.get(at) if at < len(code) and code[at] == "(" else None
        if after and (close is None or not after.match(code, close + 1)):
            continue
        taken = m.end("name")
        first = line_of(m.start("indent"))
        body = at if close is None else close + 1
        last = indented(first) if family == "python" else braced(m.end("only") if m.groupdict().get("only") else body)
        while opened and opened[-1][2] < first:
            opened.pop()
        around = next((n for n, a, b in reversed(opened) if a < first <= b), "")
        if kind in ("class", ""):
            opened.append((name, first, last))
        if not kind:
            continue
        owner = m.groupdict().get("owner") or (around if kind != "class" else "")
        kind = "method" if kind == "function" and owner and family in ("python", "rust", "java", "c") else kind
        found.append((kind, name, owner, first, last))
        names.add(m.start("name"))
        if kind != "class" and (family, kind) not in WITHOUT:
            own = [m["only"]] if m.groupdict().get("only") else parameters(code[at + 1 : close], family == "python") if close is not None else []
            params += [("param", p, name, first, first) for p in own]
    rest = []  # line, place, symbol
    text = content if family in SOURCES_QUOTED else code
    blocks = [(m.end() - 1, ends.get(m.end() - 1, len(code))) for m in re.finditer(r"^import[ \t]*\(", code, re.M)] if family == "go" else []
    seen = set()
    for rule in IMPORTS_C[family]:
        for m in rule.finditer(text):
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            if code[at] != text[at] or code[at].isspace() or (blocks or family == "go") and not text.startswith("import", at) and not any(a < at < b for a, b in blocks):
                continue
            n = line_of(at)
            if n in seen:
                continue
            seen.add(n)
            rest.append((n, 0, ("import", m["source"], "", n, n)))
            for name in re.findall(NAME, re.sub(rf"{NAME}\s+as\s+", "", code[slice(*m.span("names"))] if m.groupdict().get("names") else "")):
                if name not in ("as", "type", "default"):
                    rest.append((n, 0, ("import_name", name, m["source"], n, n)))
    if family == "javascript":
        for m in EXPORT.finditer(code):
            n = line_of(m.start() + len(m[0]) - len(m[0].lstrip()))
            for name in [m["name"] or m["other"]] if m["name"] or m["other"] else re.findall(NAME, re.sub(rf"\s+as\s+{NAME}", "", m["list"] or "")):
                rest.append((n, 1, ("export", name, "", n, n)))
    for m in CALL.finditer(code):
        if m["name"] not in NO_CALL and m.start("name") not in names and not DEFINES.search(code, max(m.start() - 16, 0), m.start()):
            n = line_of(m.start())
            rest.append((n, 2, ("call", m["name"], "", n, n)))
    return found + [s for _, _, s in sorted(rest, key=lambda r: r[:2])] + params


def symbols(files: DataFrame, extractor: Extractor = extract) -> DataFrame:
    """Symbols of files (file_path, content) in languages that are parsed; files that fail give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content, language in zip(b.file_path, b.content, b.language):
                try:
                    found = extractor(content or "", language)
                except Exception:  # noqa: BLE001  a file that can't be parsed has no symbols
                    found = []
                rows += [(path, *s, i) for i, s in enumerate(found)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    of = paths.lookup(paths.PARSED, paths.extension(F.col("file_path")))
    return files.select("file_path", "content", of.alias("language")).where("language is not null").mapInPandas(run, SCHEMA)
