"""Source text to statements: strings and comments masked in place, statements cut at braces and semicolons over lines.

One expression for each language finds its strings and comments; what they hold becomes blanks, so offsets and lines
stay. A statement is what stands between braces and semicolons outside of parentheses, whatever lines it covers; its head is
matched with the language's declarations. Declarations, calls and uses are rows with offsets; a sweep finds what encloses them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

_LINE, _BLOCK, _DOUBLE, _SINGLE = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)", r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"
_TICK = r"`(?:\\.|[^`\\])*`"
#: Comments, then strings, of each language.
MARKS = {
    "java": (f"{_LINE}|{_BLOCK}", rf'"""(?:\\.|.)*?"""|{_DOUBLE}|{_SINGLE}'),
    "csharp": (f"{_LINE}|{_BLOCK}", rf'"""(?:.)*?"""|[$]?@[$]?"(?:""|[^"])*"|{_DOUBLE}|{_SINGLE}'),
    "c": (f"{_LINE}|{_BLOCK}", f"{_DOUBLE}|{_SINGLE}"),
    "cpp": (f"{_LINE}|{_BLOCK}", rf'R"(?P<raw>[^()\s\\]{{0,16}})\(.*?\)(?P=raw)"|{_DOUBLE}|(?<!\w){_SINGLE}'),
    "php": (rf"{_LINE}|#(?!\[)[^\n]*|{_BLOCK}", r"<<<\s*['\"]?(?P<doc>\w+)['\"]?\n.*?\n\s*(?P=doc)\b|" + r'"(?:\\.|[^"\\])*"|' + r"'(?:\\.|[^'\\])*'"),
    "go": (f"{_LINE}|{_BLOCK}", f"{_DOUBLE}|{_SINGLE}|`[^`]*`"),
    "rust": (f"{_LINE}|{_BLOCK}", rf'r(?P<raw>#+)".*?"(?P=raw)|r"[^"]*"|"(?:\\.|[^"\\])*"|' + r"'(?:\\.[^']*|[^'\\\n])'"),
    "javascript": (f"{_LINE}|{_BLOCK}", f"{_DOUBLE}|{_SINGLE}|{_TICK}"),
}
MARKS["typescript"] = MARKS["javascript"]

_ARGS = r"\((?P<params>[^()]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^()]*)*)\)"
_PLAIN = r"[^<>{};=()]*"
_GENERIC = rf"(?:\s*<{_PLAIN}(?:<{_PLAIN}(?:<{_PLAIN}>{_PLAIN})*>{_PLAIN})*>)?"
_TYPED = r"(?<=[\w\]>?])[\s*&][\s*&]*"
_METHOD = rf"{_TYPED}(?P<name>[A-Za-z_]\w*){_GENERIC}\s*{_ARGS}"
_SCRIPT = [
    ("class", rf"(?<![.\w])(?:abstract\s+)?class\s+(?P<name>\w+){_GENERIC}\s*(?:extends\s+(?P<bases>[\w.]+){_GENERIC}\s*)?(?:implements\s+(?P<also>[^{{]+?)\s*)?$", "{"),
    ("function", rf"(?<![.\w])(?:async\s+)?function\s*\*?\s*(?P<name>\w+){_GENERIC}\s*{_ARGS}(?:\s*:[^;]+)?\s*$", "{"),
    ("function", rf"(?<![.\w])(?:const|let|var)\s+(?P<name>\w+)(?:\s*:[^=]+?)?\s*=\s*(?:async\s*)?(?:{_ARGS}|\w+)(?:\s*:[^=]+?)?\s*=>", "{;"),
]
_IN_SCRIPT_CLASS = ("method", rf"(?:^|\n|[\s;}}])(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+|\*\s*)*(?P<name>[A-Za-z_$#][\w$]*){_GENERIC}\s*{_ARGS}(?:\s*:[^;{{]+)?\s*$", "{")
#: Language: (kind, expression searched in a statement, what may close the statement); `method` rules hold inside of types only.
DECLARATIONS: dict[str, list[tuple[str, str, str]]] = {
    "java": [
        (r"class", rf"(?<![.\w])class\s+(?P<name>\w+){_GENERIC}\s*(?:extends\s+(?P<bases>[\w.]+){_GENERIC}\s*)?(?:implements\s+(?P<also>[^{{]+?)\s*)?(?:permits[^{{]+)?$", "{"),
        ("annotation", r"@interface\s+(?P<name>\w+)\s*$", "{"),
        ("interface", rf"(?<![.@\w])interface\s+(?P<name>\w+){_GENERIC}\s*(?:extends\s+(?P<also>[^{{]+?)\s*)?$", "{"),
        ("enum", r"(?<![.\w])enum\s+(?P<name>\w+)\s*(?:implements\s+(?P<also>[^{]+?)\s*)?$", "{"),
        ("record", rf"(?<![.\w])record\s+(?P<name>\w+){_GENERIC}\s*{_ARGS}\s*(?:implements\s+(?P<also>[^{{]+?)\s*)?$", "{"),
        ("method", rf"{_METHOD}\s*(?:throws\s+[\w.,\s]+)?(?:default\s+[^;]+)?$", "{;"),
    ],
    "csharp": [
        *((k, rf"(?<![.\w]){k}\s+(?P<name>\w+){_GENERIC}\s*(?:\([^()]*\)\s*)?(?::\s*(?P<also>[^{{]+?)\s*)?(?:where\s[^{{]+)?$", "{") for k in ("class", "struct", "record", "interface", "enum")),
        ("method", rf"{_METHOD}\s*(?:where\s[^{{;]+)?(?:=>.*)?$", "{;"),
    ],
    "c": [("struct", r"\bstruct\s+(?P<name>\w+)\s*$", "{"), ("enum", r"\benum\s+(?P<name>\w+)\s*$", "{"), ("function", rf"{_METHOD}\s*$", "{")],
    "cpp": [
        *((k, rf"(?<!enum\s)\b{k}\s+(?:\w+\s+)??(?P<name>\w+)(?:\s*<[^{{}}]*>)?\s*(?:final\s*)?(?::(?!:)\s*(?P<also>[^{{]+?)\s*)?$", "{") for k in ("class", "struct")),
        ("enum", r"\benum\s+(?:class\s+|struct\s+)?(?P<name>\w+)\s*(?::\s*[\w:]+\s*)?$", "{"),
        ("function", rf"(?:{_TYPED}|^\s*|[;}}]\s*|(?<!:):\s*)(?P<name>(?:\w+::)*~?\w+)\s*{_ARGS}\s*(?:const|noexcept|override|final|&&?|->\s*[\w:<>*&\s]+|\s)*(?:=\s*(?:default|delete)\s*|:(?!:)[^;{{]*(?:\([^()]*\)|\{{[^{{}}]*\}})[^;{{]*)?$", "{"),
    ],
    "php": [
        ("class", r"(?<![:\w$])class\s+(?P<name>\w+)\s*(?:extends\s+(?P<bases>[\w\\]+)\s*)?(?:implements\s+(?P<also>[^{]+?)\s*)?$", "{"),
        *((k, rf"\b{k}\s+(?P<name>\w+)\s*(?::\s*\w+\s*)?(?:extends\s+(?P<bases>[\w\\]+)[^{{]*)?(?:implements\s+(?P<also>[^{{]+?)\s*)?$", "{") for k in ("interface", "trait", "enum")),
        ("function", rf"\bfunction\s+&?(?P<name>\w+)\s*{_ARGS}\s*(?::\s*[\w\\|?]+\s*)?$", "{;"),
    ],
    "go": [
        ("struct", r"\btype\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\s*$", "{"),
        ("interface", r"\btype\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\s*$", "{"),
        ("function", rf"\bfunc\s+(?:\((?P<receiver>[^()]*)\)\s*)?(?P<name>\w+)(?:\[[^\]]*\])?\s*{_ARGS}[^{{}};]*$", "{"),
    ],
    "rust": [
        *((k, rf"\b{k}\s+(?P<name>\w+)(?:\s*<[^{{;]*>)?\s*(?:\([^;]*\)\s*)?(?::\s*(?P<also>[^{{]+?))?\s*(?:where\s[^{{]+)?$", "{;") for k in ("struct", "enum", "union", "trait")),
        ("impl", r"\bimpl\b(?:\s*<[^{]*?>)?\s*(?:(?P<also>[\w:]+)(?:<[^{]*?>)?\s+for\s+)?(?P<name>\w+)(?:<[^{]*>)?\s*(?:where\s[^{]+)?$", "{"),
        ("function", rf"\bfn\s+(?P<name>\w+)(?:\s*<[^{{;]*?>)?\s*{_ARGS}\s*(?:->\s*[^{{;]+)?(?:where\s[^{{;]+)?$", "{;"),
    ],
    "javascript": [*_SCRIPT, _IN_SCRIPT_CLASS],
    "typescript": [
        *_SCRIPT, ("interface", rf"(?<![.\w])interface\s+(?P<name>\w+){_GENERIC}\s*(?:extends\s+(?P<also>[^{{]+?)\s*)?$", "{"), ("enum", r"(?<![.\w])enum\s+(?P<name>\w+)\s*$", "{"),
        ("type", rf"(?<![.\w])type\s+(?P<name>\w+){_GENERIC}\s*=", "{;"), _IN_SCRIPT_CLASS,
    ],
}
#: References read off the text with strings but without comments: (kind, expression).
STRINGS = {
    "java": [("imports", r"^[ \t]*import\s+(?:static\s+)?([\w.]+)")],
    "csharp": [("imports", r"^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;")],
    "c": [("include", r"^[ \t]*#\s*include\s*[<\"]([^>\"\n]+)[>\"]"), ("hls_pragma", r"^[ \t]*#\s*pragma\s+HLS\s+([^\n]+?)[ \t\r]*$")],
    "php": [("imports", r"^[ \t]*use\s+([\w\\]+)"), ("include", r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]")],
    "go": [("imports", r"^[ \t]*(?:import\s+)?(?:[\w.]+\s+)?\"([\w./-]+)\"[ \t\r]*$")],
    "rust": [("imports", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([\w:]+)")],
    "javascript": [("imports", r"(?:\bfrom\s+|\brequire\(\s*|\bimport\s+|\bimport\(\s*)['\"]([^'\"\n]+)['\"]")],
}
STRINGS["cpp"], STRINGS["typescript"] = STRINGS["c"], STRINGS["javascript"]
#: Words that look like calls, and names of a language that are no references.
WORDS = frozenset("if for while switch return sizeof catch function class new typeof await yield do else elif in not and or throw case delete super this self try async constructor default".split())
OWN_WORDS = {
    "go": frozenset("go defer select range func".split()),
    "rust": frozenset("match unsafe fn loop".split()),
    "csharp": frozenset("lock foreach using nameof when checked unchecked fixed".split()),
    "java": frozenset("assert synchronized".split()),
    "php": frozenset("echo print foreach match fn isset empty unset array list elseif die exit".split()),
    "c": frozenset("alignof".split()),
    "cpp": frozenset("alignof decltype static_assert static_cast dynamic_cast const_cast reinterpret_cast noexcept".split()),
}
BUILT_IN = {
    "java": frozenset("boolean byte char double float int long short Boolean Byte Character Double Float Integer Long Short String Object List Set Map Collection Optional void Void".split()),
    "cpp": frozenset("bool char double float int long short signed unsigned void auto size_t string vector map set pair".split()),
    "typescript": frozenset("Promise Array Map Set Record Partial Readonly String Number Boolean Object Function Date".split()),
    "go": frozenset("import type var const make new len cap append copy delete close panic recover print println error nil fmt log os io strings strconv".split()),
}
#: Of those, names that can be declared.
NAMES = frozenset("new delete default super self".split())
_TYPES = {"class", "abstract class", "template_class", "struct", "record", "interface", "enum", "trait", "impl", "annotation", "union"}
_CALL = re.compile(r"(?<![\w.$@#~])(?<!::)(?<!->)([A-Za-z_$][\w$]*(?:(?:\?\.|\.|::|->)[A-Za-z_$][\w$]*)*)(?:\s*!)?(?:(?:::)?\s*<[\w\s,.:*&]*>)?\s*\(")
_NEW = re.compile(r"\bnew\s+([A-Za-z_][\w.:\\]*)")
_FIELD = re.compile(r"(?:^|[\s;}])(?:(?:public|protected|private|internal|static|final|readonly|const|volatile|transient|mutable)\s+)*([A-Za-z_][\w.:]*)(?:\s*<[^;=]*>)?(?:\s*\[\])?[\s*&]+(\w+)\s*(?:=.*)?$", re.S)
_LOCAL = re.compile(r"\b([A-Z]\w*)(?:\s*<[^<>;{}()]*>)?[\s*&]+([a-z_]\w*)\s*(?=[=;,):(])")
_COLON = re.compile(r"[\w)\]]\s*[?!]?\s*:\s*([A-Z]\w*)")


def masked(text: str, language: str) -> tuple[str, str]:
    """The text without comments, and also without what strings hold; same length, same lines."""
    comments, strings = MARKS[language]
    both = re.compile(f"(?P<comment>{comments})|(?:{strings})", re.S)
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    spoken = both.sub(lambda m: blank(m[0]) if m["comment"] else m[0], text)
    bare = both.sub(lambda m: blank(m[0]) if m["comment"] else m[0][0] + blank(m[0][1:-1]) + m[0][-1], text)
    if language in ("c", "cpp"):  # preprocessor lines, continued ones too
        bare = re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\\n|\\.)*", lambda m: blank(m[0]), bare)
    return spoken, bare


def statements(bare: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, what closes it) of the stretches between braces and semicolons outside of parentheses; the last is closed by ''.

    A brace inside of parentheses opens a block behind `)`, `=>` or a word of control; else it is a value and cuts nothing.
    """
    start, held = 0, []
    for m in re.finditer(r"[(){}\[\];]", bare):
        c = m[0]
        inside = bool(held) and held[-1] != "{"
        if c in "([" or c == "{" and inside and not re.search(r"(?:\)|=>|\b(?:do|else|try|finally))\s*$", bare[max(m.start() - 40, 0) : m.start()]):
            held.append("(" if c != "{" else "value")
        elif c in ")]" or c == "}" and inside:
            if inside:
                held.pop()
        elif c != ";" or not inside:
            if c == "{":
                held.append("{")
            elif c == "}" and held:
                held.pop()
            yield start, m.start(), c
            start = m.end()
    yield start, len(bare), ""


def _targets(names: str | None) -> list[str]:
    """Names of a list of bases, without access words and type arguments."""
    plain = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", names or ""))
    return [w for part in re.split(r"[,+]", plain) if (w := part.split("(")[0].split()[-1] if part.split() else "")]


def scan(language: str, content: str) -> tuple[list[dict], list[tuple[int, str | None, str, str]]]:
    """Declarations (kind, name, parent, start, head, end, statement, bases) and references (offset, origin, kind, target)."""
    spoken, bare = masked(content, language)
    rules = [(k, re.compile(p, re.S), closers) for k, p, closers in DECLARATIONS[language]]
    words = WORDS | OWN_WORDS.get(language, frozenset())
    found, links, built_in = [], [], BUILT_IN.get(language, frozenset())
    open_: list[tuple[dict | None, dict | None]] = []  # for each open brace its declaration, and the innermost one around what it holds

    def end(at: int) -> None:
        if open_ and (row := open_.pop()[0]) is not None:
            row["end"] = at

    for start, stop, closer in statements(bare):
        head = bare[start:stop]
        own, inner = open_[-1] if open_ else (None, None)
        within = inner if inner and inner["kind"] in _TYPES else None
        direct = within is not None and own is within
        rows: dict[int, dict] = {}
        for kind, rule, closers in rules:
            if closer not in closers or not closer or kind == "method" and not direct:
                continue
            for m in rule.finditer(head):
                named = m.groupdict()
                before = re.findall(r"[\w=]+", head[: m.start("name")])[-1:]
                if named["name"] in words - NAMES or kind in ("method", "function") and (before and before[0] in (words - {"function", "fn", "func", "async", "default"} | {"="}) or within and language == "java" and named["name"] == within["name"]):
                    continue
                rows.setdefault(m.start("name"), _declared(language, kind, named, m, within, start, stop, head) | {"body": stop if closer == "{" else start})
        here = [rows[k] for k in sorted(rows)]
        for row, following in zip(here, here[1:], strict=False):  # ended by a line's end
            row["end"], row["body"] = following["start"] - 1, row["start"]
        found += here
        links.extend((row["at"], row["id"], "extends", b) for row in here for b in row["bases"] if b not in built_in)
        row = here[-1] if here else None
        if direct and not row and closer == ";" and language in ("java", "csharp", "cpp") and (m := _FIELD.search(head)) and m[1] not in built_in | words:
            links.append((start + m.start(1), within["id"], "uses", m[1]))
        if direct and language == "typescript":
            links.extend((start + m.start(1), within["id"], "uses", m[1]) for m in _COLON.finditer(head) if m[1] not in built_in)
        if closer == "{":
            open_.append((row, row or inner))
        elif closer == "}":
            end(stop)
    while open_:
        end(len(bare))
    links += _calls(language, bare, found, built_in, words)
    for kind, rule in STRINGS[language]:
        links.extend((m.start(1), None, kind, m[1]) for m in re.finditer(rule, spoken, re.M))
    return [r for r in found if r["kind"] != "impl"], sorted(links, key=lambda r: r[0])


def _declared(language: str, kind: str, named: dict, m: re.Match, within: dict | None, start: int, stop: int, head: str) -> dict:
    """A declaration's row; `at` is the place of its name, `head` its statement on one line."""
    name, parent = named["name"], within["id"] if within else None
    if language == "go" and named.get("receiver"):
        kind, parent = "method", re.findall(r"\w+", re.sub(r"\[.*", "", named["receiver"]))[-1]
    elif "::" in name:
        parent, _, name = name.rpartition("::")
        kind, parent = "method", parent.replace("::", ".")
    elif kind == "function" and parent:
        kind = "method"
    elif kind == "class" and re.search(r"\babstract\s+(?:\w+\s+)*$|\babstract\b", head[: m.start("name")]):
        kind = "abstract class"
    if language == "cpp" and kind == "class" and "template" in head[: m.start("name")]:
        kind = "template_class"
    # without semicolons a statement may begin lines before its declaration
    lead = head.rfind("\n", 0, m.start("name")) + 1 if language in ("javascript", "typescript", "go") else 0
    first = start + lead + len(head[lead:]) - len(head[lead:].lstrip())
    known = name if kind == "impl" or not parent else f"{parent}.{name}"
    return {"kind": kind, "name": name, "parent": parent, "id": known, "start": first, "at": start + m.start("name"), "end": stop, "head": " ".join(head[lead:].split()), "bases": _targets(named.get("bases")) + _targets(named.get("also"))}


def _calls(language: str, bare: str, found: list[dict], built_in: frozenset, words: frozenset) -> list[tuple[int, str | None, str, str]]:
    """Calls and creations outside of declared heads, each with the innermost declaration around it; a receiver's type, where the file declares one, takes its place."""
    rows = sorted(found, key=lambda r: r["start"])
    heads = {r["at"] for r in rows}
    types = sorted((m.start(2), m[2], m[1]) for m in _LOCAL.finditer(bare)) if language in ("java", "csharp", "cpp") else []
    made, out, open_, k = {m.start(1) for m in _NEW.finditer(bare)}, [], [], 0
    given: dict[str, str] = {}
    marks = sorted([(m.start(1), "calls", m[1]) for m in _CALL.finditer(bare) if m.start(1) not in made] + [(m.start(1), "creates", m[1]) for m in _NEW.finditer(bare)])
    t = 0
    for at, kind, target in marks:
        while k < len(rows) and rows[k]["start"] <= at:
            open_.append(rows[k])
            k += 1
        while open_ and open_[-1]["end"] < at:
            open_.pop()
        while t < len(types) and types[t][0] <= at:
            given[types[t][1]] = types[t][2]
            t += 1
        last = re.split(r"\?\.|\.|::|->", target)
        around = open_[-1] if open_ else None
        if at in heads or len(last) == 1 and target in words or target in built_in or around and (at < around["body"] or target == around["name"] and around["kind"] in _TYPES):
            continue
        if language in ("c", "cpp", "go") and (around["kind"] in _TYPES if around else language != "go"):  # prototypes
            continue
        if len(last) > 1 and last[0] in given:
            target = ".".join([given[last[0]], *last[1:]])
        out.append((at, around["id"] if around else None, kind, target))
    return out


class Lines:
    """Line numbers, from 1, of offsets."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def __call__(self, at: int) -> int:
        return bisect_right(self.starts, at)


def logical_lines(text: str, parens: bool) -> Iterator[tuple[int, int, str]]:
    """(first, last, text) of lines with what continues them: after a backslash, or, for parens, until all are closed."""
    first, held = 1, []
    for n, row in enumerate(text.split("\n"), 1):
        held.append(row)
        joined = " ".join(x[:-1] if x.endswith("\\") else x for x in held)
        if row.endswith("\\") or parens and joined.count("(") > joined.count(")"):
            continue
        yield first, n, joined
        first, held = n + 1, []
    if held:
        yield first, first + len(held) - 1, " ".join(held)
