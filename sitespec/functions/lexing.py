"""Scripts as tokens: text without strings and comments, balanced brackets, functions and calls.

Both passes are Arrow functions: a fold of built-in functions copies and interprets its state at every token. Patterns
read ASCII classes and line ends as Spark's do.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Scripts whose results are turned into an Arrow array at once.
SLICE = 100

# States of the lexer.
CODE, DOUBLE, SINGLE, TEMPLATE, LINE, COMMENT, REGEX = range(7)

ANONYMOUS = "(anonymous)"

_WORD = r"[\w$]"
_DELIMITERS = r"(){}\[\],;"
# The end of a text or, as Spark's ``$``, what stands before a last line end.
_END = "(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\\Z)"


def _pattern(text: str) -> re.Pattern:
    return re.compile(text.replace("<END>", _END), re.ASCII)


# Fixed values of the language: what a regular expression may follow, and heads of blocks that are no functions.
_BEFORE_REGEX = _pattern(
    r"(?:^|[(,=:\[!&|?{};+\-*%~^<>]|(?<![\w$.])(?:return|typeof|case|in|of|delete|void|throw|new|else|do|instanceof|await|yield))<END>"
)
_NO_FUNCTION = _pattern(r"(?<![\w$.])(?:if|for|while|switch|catch|with|await)\s*+<END>")
_NO_CALL = _pattern(
    rf"(?<![\w$.])(?:if|for|while|switch|catch|with|function|return|typeof|function\s*+\*?+\s*+{_WORD}++)\s*+<END>"
)

_ATOM = _pattern(r"\$\{|[^\\\"'`/*{}$\[\]\n]++|[\\\"'`/*{}$\[\]\n]")
_LEXED = _pattern("[\"'`/]")
_CUT = _pattern(rf"[^{_DELIMITERS}]*+[{_DELIMITERS}]|[^{_DELIMITERS}]++\Z")
_BRACKET = _pattern(r"[({]")
_ARROW_FIRST = _pattern(r"^\s*+=>")
_BARE = _pattern(rf"(?s)^(.*)(?<!{_WORD})({_WORD}++)\s*+=>")
_NEW_LINE = _pattern(rf"^[ \t\r]*+\n\s*+{_WORD}")
_CHAINED = _pattern(r"^\s*+\??\.")
_CALLEE = _pattern(rf"(?<![\w$.?])((?:{_WORD}|\??\.)++)\s*+<END>")
_AWAITED = _pattern(r"(?<![\w$.])await\s++[\w$.?]++\s*+<END>")
_ARROW_NAMED = _pattern(rf"({_WORD}++)\s*+[:=]\s*+(?:async\s*+)?<END>")
_FUNCTION_NAMED = (
    _pattern(rf"({_WORD}++)\s*+[:=]\s*+(?:async\s++)?function\s*+\*?+\s*+<END>"),
    _pattern(rf"(?<!{_WORD})(?!function(?!{_WORD}))({_WORD}++)\s*+<END>"),
)

_LISTED = _pattern(r"[^(){}\[\],]*+[(){}\[\],]|[^(){}\[\],]++\Z")
_NAME = _pattern(rf"({_WORD}++)")

_BLANKS, _ASCII_SPACE = " \t\r\n", " \t\r\n\f\v"

FUNCTION = "struct<name:string,depth:int,p_open:int,p_close:int>"
EVENT = (
    f"struct<kind:string,name:string,line:int,start:int,end:int,root:int,awaited:boolean,fn:{FUNCTION}>"
)
CALL = EVENT[:-1] + ",parameters:array<string>,arguments:array<struct<raw:string,masked:string>>>"
_FUNCTION_FIELDS = (("name", pa.string()), ("depth", pa.int32()), ("p_open", pa.int32()), ("p_close", pa.int32()))
_EVENT_FIELDS = (
    ("kind", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
    ("root", pa.int32()), ("awaited", pa.bool_()),
)


def _strings(values: Iterator[str | None]) -> pa.Array:
    return pa.array(values, pa.string())


def _structs(rows: list[tuple], fields: tuple[tuple[str, pa.DataType], ...], *more: tuple[str, pa.Array], mask: pa.Array | None = None) -> pa.Array:
    """Rows of values as an array of structs, column by column: many times faster than from a dict a row."""
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    made = [pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.StructArray.from_arrays([*made, *(a for _, a in more)], [*(n for n, _ in fields), *(n for n, _ in more)], mask=mask)


def _lists(rows: Iterator[list | None], of: Callable[[list], pa.Array]) -> pa.Array:
    """Lists of values that ``of`` turns into one array; None is NULL."""
    offsets, values, gone = [0], [], []
    for row in rows:
        values.extend(row or ())
        offsets.append(len(values))
        gone.append(row is None)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), of(values), mask=pa.array(gone, pa.bool_()))


def _event_array(events: list[tuple], *more: tuple[str, pa.Array]) -> pa.Array:
    around = [e[-1] for e in events]
    outside = pa.array([fn is None for fn in around], pa.bool_())
    functions = _structs([fn or (None,) * len(_FUNCTION_FIELDS) for fn in around], _FUNCTION_FIELDS, mask=outside)
    return _structs([e[:-1] for e in events], _EVENT_FIELDS, ("fn", functions), *more)


def _call_array(calls: list[tuple]) -> pa.Array:
    """Events with their parameters and arguments."""
    parameters = _lists((c[1] for c in calls), lambda names: pa.array(names, pa.string()))
    arguments = _lists((c[2] for c in calls), lambda parts: _structs(parts, (("raw", pa.string()), ("masked", pa.string()))))
    return _event_array([c[0] for c in calls], ("parameters", parameters), ("arguments", arguments))


def _by_script(fn: Callable, arrow: Callable[[Iterator], pa.Array], returned: str) -> Callable[[Column], Column]:
    """``fn`` over a column of scripts."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [arrow(map(fn, batch.slice(i, SLICE).to_pylist())) for i in range(0, len(batch), SLICE)]
            yield pa.concat_arrays(parts or [arrow(iter(()))])

    @wraps(fn)
    def over(script: Column) -> Column:
        return F.arrow_udf(run, returned)(script)

    return over


def _by_both(fn: Callable, arrow: Callable[[Iterator], pa.Array], returned: str) -> Callable[[Column, Column], Column]:
    """``fn`` over columns of scripts and masked scripts."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, masked in batches:
            cut = range(0, len(texts), SLICE)
            parts = [arrow(map(fn, texts.slice(i, SLICE).to_pylist(), masked.slice(i, SLICE).to_pylist())) for i in cut]
            yield pa.concat_arrays(parts or [arrow(iter(()))])

    @wraps(fn)
    def over(text: Column, masked: Column) -> Column:
        return F.arrow_udf(run, returned)(text, masked)

    return over


def _masked(js: str | None) -> str | None:
    """The script with the insides of strings, templates, comments and regular expressions blanked.

    Every character stays at its place: quotes, the slashes of a regular expression, line ends and the code within
    ``${}`` are kept, all else there becomes spaces (``${`` and its ``}`` too). An unclosed string ends with its line,
    an unclosed comment or template with the script. A slash after an operator, an opening bracket, a semicolon,
    ``{``, ``}`` or a word such as ``return`` begins a regular expression, else it divides. NULL stays NULL.
    """
    if js is None or not _LEXED.search(js):
        return js
    atoms = _ATOM.findall(js)
    mode, escaped, flag, depth, last = CODE, False, 0, 0, ""
    stack: list[int] = []  # depths at which the code within a template began
    out = []
    for number, t in enumerate(atoms):
        if mode == CODE:
            put = t
            if t in ('"', "'", "`"):
                mode = DOUBLE if t == '"' else SINGLE if t == "'" else TEMPLATE
            elif t == "/":
                behind = atoms[number + 1] if number + 1 < len(atoms) else ""
                if behind == "/":
                    put, mode = " ", LINE
                elif behind == "*":
                    put, mode, flag = " ", COMMENT, 2
                elif _BEFORE_REGEX.search(last.rstrip(" ")):
                    mode, flag = REGEX, 0
                else:
                    last = t
            elif t in ("{", "${"):
                depth, last = depth + 1, "{"
            elif t == "}":
                if stack and stack[-1] == depth:
                    put, mode = " ", TEMPLATE
                    stack.pop()
                else:
                    depth, last = depth - 1, t
            elif t.strip(_BLANKS):
                last = t
            out.append(put)
            continue
        put = t if t == "\n" else " " * len(t)
        if mode == LINE:
            if t == "\n":
                mode = CODE
        elif mode == COMMENT:  # flag 2: the star that opens it, 1: another star stood before
            if t == "/" and flag == 1:
                mode, flag = CODE, 0
            else:
                flag = 1 if t == "*" and flag != 2 else 0
        elif mode == REGEX and t == "\n":
            mode, escaped, last = CODE, False, "/"
        elif escaped:
            escaped = False
        elif t == "\\":
            escaped = True
        elif mode == REGEX:  # flag 1: within a class
            if t == "/" and flag == 0:
                put, mode, last = t, CODE, t
            elif t in ("[", "]"):
                flag = 1 if t == "[" else 0
        elif mode == TEMPLATE:
            if t == "`":
                put, mode, last = t, CODE, t
            elif t == "${":
                mode, last = CODE, "{"
                stack.append(depth)
        elif t == ('"' if mode == DOUBLE else "'"):
            put, mode, last = t, CODE, t
        elif t == "\n":
            mode = CODE
        out.append(put)
    return "".join(out)


# The kind of a frame for the body of an arrow function without braces; it ends with the expression.
_ARROW = ">"


def _found(text: str, pattern: re.Pattern) -> str | None:
    hit = pattern.search(text)
    return hit[1] if hit else None


def _arrow_name(head: str) -> str:
    return _found(head, _ARROW_NAMED) or ANONYMOUS


def _function_name(head: str) -> str:
    return _found(head, _FUNCTION_NAMED[0]) or _found(head, _FUNCTION_NAMED[1]) or ANONYMOUS


def _events(masked: str | None) -> list[tuple]:
    """Calls and function bodies of a masked script, each where its bracket closes: ``array<EVENT>``.

    A stack holds the brackets that are open, with the innermost function at each. A call has the ``name`` before its
    bracket (dotted as written), the places (from 0) of its brackets, its line, whether it is awaited, the first
    bracket of its chain (``root``), and the function around it. A function has its own name, depth and the places of
    the brackets of its parameters. Bodies are ``{}`` after ``)`` or ``=>``, other than those of ``if``, ``for`` and
    the like; an arrow function without braces ends with its expression and has no event of its own. Brackets that
    never close have no event; one of the wrong kind closes what is open.
    """
    out: list[tuple] = []
    if masked is None or not _BRACKET.search(masked):
        return out
    stack: list[tuple] = []  # kind, start, line, head, root, base, own, function
    closed = None  # head, start, end and root of the ``()`` that has just closed
    pos, line = 0, 1
    for text in _CUT.findall(masked):
        d = text[-1] if text[-1] in "(){}[],;" else ""
        run = text[:-1] if d else text
        if stack and stack[-1][0] == _ARROW and (d in (",", ";", ")", "]", "}") or _NEW_LINE.search(run)):
            del stack[stack[-1][5]:]
        inner = stack[-1] if stack else None
        at, line = pos + len(text) - 1, line + text.count("\n")
        was, closed = closed, None
        if d and d in "([{":
            new = _new_function(run, d, was, inner, pos)
            fn = new or (inner[7] if inner else None)
            root = was[3] if was and _CHAINED.search(run) else at
            base = inner[5] if inner and inner[0] == _ARROW else len(stack)
            head = run if d == "(" else ""
            if new and d != "{":
                stack.append((_ARROW, at, line, head, root, base, False, fn))
            stack.append((d, at, line, head, root, base, new is not None and d == "{", fn))
        elif d and d in ")]}" and inner:
            stack.pop()
            kind, start, begun, head, root, _, own, fn = inner
            if d == ")":
                closed = head, start, at, root
            callee = _found(head, _CALLEE) if kind == "(" else None
            if callee and not _NO_CALL.search(head):
                out.append(("call", callee, begun, start, at, root, _AWAITED.search(head) is not None, fn))
            elif own:
                out.append(("function", fn[0], begun, start, at, root, False, fn))
        pos += len(text)
    return out


def _new_function(run: str, d: str, closed: tuple | None, inner: tuple | None, pos: int) -> tuple | None:
    """(name, depth, p_open, p_close) of the function that begins at the delimiter; None where none does."""
    depth = (inner[7][1] if inner and inner[7] else 0) + 1
    if "=>" in run:
        if closed and _ARROW_FIRST.search(run):
            return _arrow_name(closed[0]), depth, closed[1], closed[2]
        if bare := _BARE.search(run):
            ident = pos + len(bare[1])
            return _arrow_name(bare[1]), depth, ident - 1, ident + len(bare[2])
    if d == "{" and not run.strip(_BLANKS) and closed and not _NO_FUNCTION.search(closed[0]):
        return _function_name(closed[0]), depth, closed[1], closed[2]
    return None


def _parts(raw: str, masked: str) -> list[tuple[str, str]]:
    """(raw, masked) of the parts of a list, cut at its own commas; see ``arguments.parts``."""
    out, depth, first, pos = [], 0, 0, 0
    for token in [*_LISTED.findall(masked), None]:
        if token is None or (token[-1] == "," and depth == 0):
            last = pos if token is None else pos + len(token) - 1
            if raw[first:last].strip(_ASCII_SPACE):
                out.append((raw[first:last], masked[first:last]))
            first = last + 1
        if token is not None:
            pos += len(token)
            depth += 1 if token[-1] in "([{" else -1 if token[-1] in ")]}" else 0
    return out


def _calls(text: str | None, masked: str | None) -> list[tuple]:
    """``bracket_events``, each with the names of the parameters of its function and, for a call, its arguments."""
    out = []
    for event in _events(masked):
        kind, _, _, start, end, _, _, fn = event
        parameters = fn and [_found(p, _NAME) or "" for p in masked[fn[2] + 1:fn[3]].split(",")]
        arguments = _parts(text[start + 1:end], masked[start + 1:end]) if kind == "call" else None
        out.append((event, parameters, arguments))
    return out


masked_js = _by_script(_masked, _strings, "string")
bracket_events = _by_script(_events, lambda scripts: _lists(scripts, _event_array), f"array<{EVENT}>")
event_calls = _by_both(_calls, lambda scripts: _lists(scripts, _call_array), f"array<{CALL}>")
