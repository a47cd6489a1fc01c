"""Declarations of languages with brace-delimited bodies.

A declaration is recognised by its header: the text between the previous
statement and the opening brace (or the end of a declaration without a body).
Comments and literals are blanked first, so the headers can be matched with
plain patterns, one list per language.
"""

from __future__ import annotations

import re

# Fixed patterns: comments and literals, whose brackets do not count.
_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_STRING = r'"(?:\\.|[^"\\\n])*"'
_CHAR = r"'(?:\\.[^'\n]*|[^'\\\n])'"
_BACKTICK = r"`(?:\\.|[^`\\])*`"
_REGEX = r"(?:(?<=[=(,:\[!&|?{};])|(?<=\breturn))\s*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/"
_JS_MASK = rf"{_COMMENT}|{_STRING}|'(?:\\.|[^'\\\n])*'|{_BACKTICK}|{_REGEX}"
MASKS = {
    "rust": rf'{_COMMENT}|b?r(#*)".*?"\1|"(?:\\.|[^"\\])*"|{_CHAR}',
    "go": rf"{_COMMENT}|{_STRING}|{_CHAR}|`[^`]*`",
    "javascript": _JS_MASK,
    "typescript": _JS_MASK,
    "tsx": _JS_MASK,
    "java": rf'{_COMMENT}|""".*?"""|{_STRING}|{_CHAR}',
    "kotlin": rf'{_COMMENT}|""".*?"""|{_STRING}|{_CHAR}',
}

# Fixed patterns: (kind, needs a body, must stand in a class body, header).
# `start` opens the chunk, `name` is the symbol; without a name it is anonymous.
# A rule without a kind marks a class-like body that is no chunk itself.
_RUST_VIS = r"^[ \t]*(?P<start>(?:pub(?:\s*\([^)]*\))?\s+)?"
_RUST_FN = r'(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+(?:"[^"]*"\s*)?|extern\s+)*'
_JS_LEAD = r"^[ \t]*(?P<start>(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
_JS_FUNCTION = r"(?:async\s+)?function\s+(?P<name>[\w$]+)\s*[<(])"
_JS_MEMBER = (
    r"^[ \t]*+(?!(?:if|for|while|switch|catch|with|function|return|new|await|typeof)\b)"
    r"(?P<start>(?:(?:public|private|protected|static|override|readonly|async|get|set)\s+)*"
    r"(?:\*\s*)?(?P<name>#?[\w$]+)\s*(?:<[^>]*>)?\s*\()"
)
_JAVA_LEAD = (
    r"^[ \t]*(?P<start>(?:@[\w.]+(?:\s*\([^)]*\))?\s+)*"
    r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default"
    r"|strictfp|sealed|non-sealed|transient)\s+)*"
)
_KOTLIN_LEAD = (
    r"^[ \t]*(?P<start>(?:@[\w.:]+(?:\s*\([^)]*\))?\s+)*"
    r"(?:(?:public|private|protected|internal|open|abstract|final|override|suspend|inline"
    r"|operator|infix|tailrec|external|data|sealed|enum|annotation|inner|value|expect|actual"
    r"|fun)\s+)*"
)
_JS_RULES = [
    ("function", True, False, _JS_LEAD + _JS_FUNCTION),
    ("class", True, False, _JS_LEAD + r"class\s+(?P<name>[\w$]+))"),
    ("method", True, False, _JS_MEMBER),
]
_TS_RULES = [
    *_JS_RULES,
    ("class", True, False, _JS_LEAD + r"interface\s+(?P<name>[\w$]+))"),
]
_RULES = {
    "rust": [
        ("function", True, False, rf"{_RUST_VIS}{_RUST_FN}fn\s+(?P<name>\w+))"),
        ("class", False, False, rf"{_RUST_VIS}struct\s+(?P<name>\w+))"),
        ("class", True, False, rf"{_RUST_VIS}enum\s+(?P<name>\w+))"),
        (
            "class",
            True,
            False,
            rf"{_RUST_VIS}(?:unsafe\s+)?(?:auto\s+)?trait\s+(?P<name>\w+))",
        ),
        ("module", False, False, rf"{_RUST_VIS}mod\s+(?P<name>\w+))"),
        ("impl", True, False, r"^[ \t]*(?P<start>(?:unsafe\s+)?impl\b)"),
    ],
    "go": [
        ("method", True, False, r"^(?P<start>func\s*\([^)]*\)\s*(?P<name>\w+)\s*\()"),
        ("function", True, False, r"^(?P<start>func\s+(?P<name>\w+)\s*[\[(])"),
        ("class", False, False, r"^[ \t]*(?P<start>type\s+\w+|type\s*\()"),
    ],
    "javascript": _JS_RULES,
    "typescript": _TS_RULES,
    "tsx": _TS_RULES,
    "java": [
        ("", True, False, rf"{_JAVA_LEAD}(?:enum|record|@interface)\s+(?P<name>\w+))"),
        ("class", True, False, rf"{_JAVA_LEAD}(?:class|interface)\s+(?P<name>\w+))"),
        (
            "method",
            False,
            True,
            rf"{_JAVA_LEAD}(?:<[^;{{}}]*?>\s+)?(?!(?:new|return|else|throw|public"
            r"|private|protected|static|final|abstract|synchronized)\b)"
            r"[\w.$]+(?:\s*<[^;{}()=]*>)?(?:\s*\[\s*\])*\s+(?P<name>\w+)\s*\()",
        ),
    ],
    "kotlin": [
        ("class", False, False, rf"{_KOTLIN_LEAD}(?:class|interface)\s+(?P<name>\w+))"),
        (
            "function",
            False,
            False,
            rf"{_KOTLIN_LEAD}(?<=fun )\s*(?:<[^>]*>\s*)?(?:[\w.<>?, ]+\.)?(?P<name>\w+)\s*\()",
        ),
    ],
}
_COMPILED = {
    lang: [(kind, body, member, re.compile(rx, re.M)) for kind, body, member, rx in rules]
    for lang, rules in _RULES.items()
}
BRACE_LANGS = tuple(_RULES)

# Languages in which a line end may end a declaration, and the
# first characters of a line that goes on with the declaration above it.
_LINE_ENDED = ("go", "kotlin")
_CONTINUES = re.compile(r"\s*[{:=.?,)\]]|\s*(?:where|else)\b")


def _blank(match: re.Match) -> str:
    return re.sub(r"[^\n]", " ", match.group())


# Fixed patterns: what may stand between the parameters and the body of a method.
_AFTER_PARAMS = {
    "java": re.compile(r"(?:\[\s*\]\s*)*(?:throws\b.*)?", re.S),
    "javascript": re.compile(r""),
    "typescript": re.compile(r"(?::.*)?", re.S),
    "tsx": re.compile(r"(?::.*)?", re.S),
}


def _ends_after_params(lang: str, tail: str) -> bool:
    depth = 1
    for i, ch in enumerate(tail):
        depth += (ch == "(") - (ch == ")")
        if depth == 0:
            return bool(_AFTER_PARAMS[lang].fullmatch(tail[i + 1 :].strip()))
    return False


def _classify(lang: str, header: str, has_body: bool, in_class: bool, offset: int):
    """(symbol or '', kind, start) of the declaration the header ends with, or None."""
    for kind, needs_body, member, rx in _COMPILED[lang]:
        if (needs_body and not has_body) or (member and not in_class):
            continue
        for m in reversed(list(rx.finditer(header))):
            before, tail = header[: m.start("start")], header[m.end() :]
            balanced = all(before.count(a) == before.count(b) for a, b in ("()", "[]"))
            if not balanced or (
                kind == "method" and lang in _AFTER_PARAMS and not _ends_after_params(lang, tail)
            ):
                continue
            name = _impl_name(tail) if kind == "impl" else m.groupdict().get("name") or ""
            return name, kind, offset + m.start("start")
    return None


def _impl_name(tail: str) -> str:
    """The first plain type name of `impl<..> Trait for Type`.

    Paths and types with arguments are no plain names.
    """
    tail = re.sub(r"\bwhere\b.*", "", tail, flags=re.S).strip()
    if tail.startswith("<"):
        depth = 0
        for i, ch in enumerate(tail):
            depth += (ch == "<") - (ch == ">" and tail[i - 1] != "-")
            if depth == 0:
                tail = tail[i + 1 :]
                break
    names = [part.strip().lstrip("!").strip() for part in re.split(r"\bfor\b", tail)]
    return next((n for n in names if re.fullmatch(r"\w+", n)), "")


def brace_spans(lang: str, text: str) -> list[tuple[str, str, int, int]]:
    """Declarations with their half-open offsets, nested ones included."""
    mask = re.sub(MASKS[lang], _blank, text, flags=re.S)
    line_ended = lang in _LINE_ENDED
    spans = []
    # One frame per open brace: its declaration, where its next header begins,
    # and how many round or square brackets are open inside it.
    stack = [[None, 0, 0]]

    def declared(end: int, has_body: bool):
        decl, begin, _ = stack[-1]
        in_class = bool(decl) and decl[1] in ("class", "")
        return _classify(lang, mask[begin:end], has_body, in_class, begin)

    def emit(decl, end: int) -> None:
        if decl and decl[1]:
            while mask[end - 1].isspace():
                end -= 1
            spans.append((*decl, end))

    for token in re.finditer(r"[{}()\[\];\n]" if line_ended else r"[{}()\[\];]", mask):
        ch, pos = token.group(), token.start()
        frame = stack[-1]
        if ch in "([":
            frame[2] += 1
        elif ch in ")]":
            frame[2] = max(0, frame[2] - 1)
        elif ch == "{":
            stack.append([declared(pos, True) if frame[2] == 0 else None, pos + 1, 0])
        elif ch == "}":
            if line_ended and frame[2] == 0:
                emit(declared(pos, False), pos)
            if len(stack) > 1:
                emit(stack.pop()[0], pos + 1)
            if stack[-1][2] == 0:
                stack[-1][1] = pos + 1
        elif frame[2] == 0 and ch == ";":
            emit(declared(pos, False), pos + 1 if lang in ("rust", "java") else pos)
            frame[1] = pos + 1
        elif frame[2] == 0 and ch == "\n" and not _CONTINUES.match(mask, pos):
            emit(declared(pos, False), pos)
            frame[1] = pos
    if line_ended and len(stack) == 1:
        emit(declared(len(mask), False), len(mask))
    return spans
