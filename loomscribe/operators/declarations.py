"""Named declarations of one source text, in one linear scan.

Strings and comments are blanked first, so that braces, brackets and keywords in them do not
count; brackets are matched with a stack; then the declarations' heads are found by pattern, and
their blocks by indentation (Python) or by the matched brace (other languages).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

DOC_CHARS = 300
_STRING = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
_QUOTED = {
    ".py": re.compile(r"'''(?:\\.|[^\\])*?'''|\"\"\"(?:\\.|[^\\])*?\"\"\"|" + _STRING + r"|#[^\n]*", re.S),
    ".rs": re.compile(r'/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\\n])\'', re.S),
    "": re.compile(r"/\*.*?\*/|//[^\n]*|`(?:\\.|[^`\\])*`|" + _STRING, re.S),
}
_MODIFIERS = r"(?:(?:export|default|declare|public|private|protected|internal|static|abstract|final|sealed|data|enum|open|override|async|readonly|unsafe|suspend|inline|virtual|partial|synchronized|native|annotation|inner|extern|pub(?:\([^)\n]*\))?|const|get|set)[ \t]+)*"
_METHOD = r"^[ \t]*(?:@\w+(?:\([^)\n]*\))?[ \t]+)*" + _MODIFIERS
_TYPED = _METHOD + r"(?:<[^>\n]*>[ \t]*)?(?P<returns>[\w.$]+(?:<[^(){};=\n]*>)?(?:\[\])*\??)[ \t]+(?P<method>\w+)[ \t]*(?=\()"
_SCRIPT = "^[ \t]*" + _MODIFIERS + r"(?:(?P<class>class|interface)|function)\b(?![ \t]*\*)[ \t]+(?P<name>[\w$]+)|" + _METHOD + r"\*?[ \t]*(?P<method>[\w$#]+)[ \t]*(?:<[^(){}\n]*>)?(?=\()"
_JVM = "^[ \t]*(?:@\\w+(?:\\([^)\n]*\\))?[ \t]+)*" + _MODIFIERS + r"(?P<class>class|interface)[ \t]+(?P<name>\w+)|" + _TYPED
#: Heads by suffix; the groups are class (set if it declares a class), name or method, and returns.
_HEADS = {
    (".py",): r"^[ \t]*(?:async[ \t]+)?(?:(?P<class>class)|def)[ \t]+(?P<name>\w+)",
    (".js", ".jsx", ".ts", ".tsx"): _SCRIPT,
    (".java", ".cs"): _JVM,
    (".kt", ".kts"): "^[ \t]*(?:@\\w+[ \t]+)*" + _MODIFIERS + r"(?:(?P<class>class|interface|object)|fun)[ \t]+(?:<[^>\n]*>[ \t]*)?(?:[\w<>?]+\.)*(?P<name>\w+)",
    (".go",): r"^(?:(?P<class>type)|func)[ \t]+(?:\([^)\n]*\)[ \t]*)?(?P<name>\w+)",
    (".rs",): "^[ \t]*" + _MODIFIERS + r"(?:(?P<class>struct|impl)|fn)\b(?:<[^>\n]*>)?[ \t]+(?P<name>\w+)",
    (".c", ".h", ".cpp", ".cc"): r"^(?P<returns>[A-Za-z_][\w:<>, \t]*?)[ \t]*[*&]*[ \t*&](?P<method>[\w:~]+)[ \t]*(?=\()",
}
HEADS = {suffix: re.compile(pattern, re.M) for suffixes, pattern in _HEADS.items() for suffix in suffixes}
_NO_NAMES = {"if", "for", "while", "switch", "catch", "return", "function", "new", "await", "typeof", "super", "throw", "else", "do", "with", "using", "lock", "foreach", "sizeof", "when", "case", "assert", "synchronized", "yield", "delete", "in", "of", "as", "is"}
#: Words that end no return type; a Java constructor has only such before its name.
_NOT_TYPES = _NO_NAMES | {"public", "private", "protected", "internal", "static", "abstract", "final", "override"}
_STOP = re.compile(r"[{};=\n(\[]")
_GOES_ON = re.compile(r"\s*(?:\{|(?:extends|implements|throws|where|with|requires)\b|->|:)")
_RETURNS = re.compile(r"\s*(?:->|:)?\s*([^{;=]*)")
_BODY_STRING = re.compile(r"\s*(?:#[^\n]*\n\s*)*([rRuUbBfF]{0,2}(?:'''(?:\\.|[^\\])*?'''|\"\"\"(?:\\.|[^\\])*?\"\"\"|" + _STRING + "))", re.S)
_BRACKETS = re.compile(r"[(){}\[\]]")
_PARAMETERS = re.compile(r"\s*(?:<[^(){}\n]*>|\[[^\]\n]*\])?\s*\(")
_COLON = re.compile(r"[:(\[{]")


class Declaration(NamedTuple):
    type: str
    name: str
    start_line: int
    end_line: int
    signature: str | None
    docstring: str | None


class Source:
    """A text with its strings and comments blanked, its lines and its matched brackets."""

    def __init__(self, text: str, suffix: str):
        self.text, self.suffix, self.comments, inside = text, suffix, {}, set()

        def blank(m: re.Match) -> str:
            found = m[0]
            spaces = re.sub(r"[^\n]", " ", found)
            if found[0] == "#" or found[:2] in ("//", "/*"):
                self.comments[m.end()] = m.start()
                return spaces
            inside.update(m.start() + i + 1 for i, c in enumerate(found) if c == "\n") if "\n" in found else None
            return found[0] + spaces[1:-1] + found[-1] if len(found) > 1 else spaces

        self.plain = _QUOTED.get(suffix, _QUOTED[""]).sub(blank, text)
        self.starts = list(accumulate(map((1).__add__, map(len, text.split("\n"))), initial=0))[:-1]
        self.match: dict[int, int] = {}
        self.nested, stack, before = inside, [], 0
        for m in _BRACKETS.finditer(self.plain):
            c, at = m[0], m.start()
            if stack and stack[-1][0] != "{":
                self._inside(before, at)
            before = at
            if c in "([{":
                stack.append((c, at))
            elif stack:
                self.match[stack.pop()[1]] = at
        if stack and stack[-1][0] != "{":
            self._inside(before, len(self.plain))

    def _inside(self, start: int, end: int) -> None:
        """The lines that begin after line breaks of a stretch are inside brackets."""
        while (start := self.plain.find("\n", start, end) + 1) > 0:
            self.nested.add(start)

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def parameters(self, at: int) -> tuple[int, int] | None:
        """The parenthesis that follows a name, with type parameters between."""
        m = _PARAMETERS.match(self.plain, at)
        return (m.end() - 1, self.match[m.end() - 1]) if m and m.end() - 1 in self.match else None

    def stop(self, at: int) -> int:
        """Where a head ends: at a brace, semicolon, equals sign or the last line break of it."""
        while m := _STOP.search(self.plain, at):
            c = m[0]
            if c in "([":
                at = self.match.get(m.start(), m.start()) + 1
            elif c == "\n" and (_GOES_ON.match(self.plain, m.end()) or self.plain[:m.start()].rstrip(" \t")[-1:] in (",", ":")):
                at = m.end()
            else:
                return m.start()
        return len(self.plain)

    def comment_before(self, at: int) -> str | None:
        """The comment that ends just before a declaration, without its markers."""
        end = at
        while end and self.text[end - 1].isspace():
            end -= 1
        start = self.comments.get(end)
        if start is None:
            return None
        found = self.text[start:end]
        for marker in ("/**", "*/", "/*", "//", "#"):
            found = found.replace(marker, "")
        return " ".join(found.split())[:DOC_CHARS] or None


def _python_ends(source: Source, heads: list[tuple[int, int]]) -> list[int]:
    """The last lines of blocks by indentation, for (start, head end) in order: one walk over the lines."""
    ends, stack, last, due = [0] * len(heads), [], 0, 0
    at = [source.line(start) for start, _ in heads] + [0]
    for number, (start, line) in enumerate(zip(source.starts, source.plain.split("\n"), strict=True), 1):
        if not line or line.isspace():
            continue
        if (stack or at[due] == number) and start not in source.nested:
            indent = len(line) - len(line.lstrip())
            while stack and indent <= stack[-1][0]:
                ends[stack.pop()[1]] = last
            if at[due] == number:
                stack.append((indent, due))
                due += 1
        last = number
    for _, k in stack:
        ends[k] = last
    return ends


def _python(source: Source, found: list[re.Match]) -> list[Declaration]:
    heads, out = [], []
    for m in found:
        span, stop = source.parameters(m.end()), m.end()
        if span:
            stop = span[1] + 1
        colon = stop
        while (mark := _COLON.search(source.plain, colon)) and mark[0] != ":":
            colon = source.match.get(mark.start(), mark.start()) + 1
        colon = mark.start() if mark else len(source.plain)
        heads.append((m.start() + len(m[0]) - len(m[0].lstrip()), span, stop, colon))
    ends = _python_ends(source, [(h[0], h[3]) for h in heads])
    for m, (start, span, stop, colon), end in zip(found, heads, ends, strict=True):
        signature = doc = None
        if span and not m["class"]:
            back = source.text[stop:colon].strip().removeprefix("->").strip()
            signature = m["name"] + source.text[span[0] : span[1] + 1] + (f" -> {back}" if back else "")
        body = _BODY_STRING.match(source.text, colon + 1)
        if body and source.line(body.start(1)) <= end:
            doc = body[1]
            if doc[:3] in ('"""', "'''"):
                doc = doc[3:-3]
            doc = doc.strip()[:DOC_CHARS]
        doc = doc or source.comment_before(start)
        out.append(Declaration("class" if m["class"] else "function", m["name"], source.line(start), end, signature, doc))
    return out


def _braced(source: Source, found: list[re.Match]) -> list[Declaration]:
    out, script = [], source.suffix in (".js", ".jsx", ".ts", ".tsx")
    for m in found:
        group = m.groupdict()
        name, is_class, returns = group.get("name") or group.get("method"), bool(group.get("class")), (group.get("returns") or "").strip()
        words = returns.split()
        if group.get("method") and (name in _NO_NAMES or (words and (words[0] in _NO_NAMES or words[-1] in _NOT_TYPES))):
            continue
        span = None if is_class else source.parameters(m.end())
        stop = source.stop(span[1] + 1 if span else m.end())
        mark = source.plain[stop : stop + 1]
        if group.get("method") and mark != "{" and (script or source.suffix in (".c", ".h", ".cpp", ".cc") or mark not in (";", "=")):
            continue
        if mark == "{":
            last = source.match.get(stop, len(source.plain) - 1)
        elif mark == "=":
            last = source.plain.find("\n", stop)
            last = len(source.plain) if last < 0 else last
        else:
            last = stop
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        signature = None
        if span:
            after = source.text[span[1] + 1 : stop] if mark != "\n" or source.suffix == ".go" else source.text[span[1] + 1 : stop].partition("\n")[0]
            back = returns or (_RETURNS.match(after)[1].strip() if source.suffix not in (".js", ".jsx", ".java", ".cs") else "")
            signature = name + source.text[span[0] : span[1] + 1] + (f" -> {back}" if back else "")
        out.append(Declaration("class" if is_class else "function", name, source.line(start), source.line(max(start, last - (mark not in "{;=" or not mark))), signature, source.comment_before(start)))
    return out


def declarations(text: str, suffix: str) -> list[Declaration]:
    """The declarations of a text in order; none for unknown suffixes.

    Nested ones are all reported.  Types of functions, enums and traits are not told apart.
    """
    if suffix not in HEADS:
        return []
    source = Source(text.replace("\r\n", "\n"), suffix)
    found = list(HEADS[suffix].finditer(source.plain))
    return _python(source, found) if suffix == ".py" else _braced(source, found)
