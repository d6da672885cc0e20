"""The grammar of TypeScript and ECMAScript: a lexer whose reading of signs depends on a pushdown automaton.

How ``/``, `````, ``<`` and ``}`` are to be read depends on what is open. The automaton alternates between *operand* and
*operator* inside expressions, knows statements, declarations, parameter lists, types, classes, enums, templates and
markup, and keeps one stack of all that is open. So it finds literals that stay open, brackets that do not match, operands
or operators that are missing, constructs of another dialect, merge-conflict markers, and a premature end. It stops at the
first error, and its cost is linear in the text. ``marks`` keeps where regular expressions, template texts and the pieces
of markup lie, for readers that need the tokens.
"""

from __future__ import annotations

import re
import sys


class Invalid(Exception):
    def __init__(self, at: int, why: str):
        super().__init__(why)
        self.at, self.why = at, why


_ID = r"(?:[^\W\d]|\$)[\w$\u200c\u200d]*"
_SPACE = r"[\s﻿]"
_skip = re.compile(r"(?:[\s﻿]+|//[^\n\r  ]*|/\*.*?\*/)*", re.S).match
_token = re.compile(
    rf"(?P<name>{_ID}(?:\??\.#?{_ID})*)"
    r"|(?P<number>0[xX][\da-fA-F](?:_?[\da-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?n?)(?![\w$])"
    r"|(?P<string>\"(?:[^\"\\\n\r]|\\(?:\r\n|.))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*')"
    r"|(?P<punct>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#`])",
    re.S,
).match
_regex = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/([A-Za-z]*)").match
_template = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)?", re.S).match
_simple_type = re.compile(
    rf"{_SPACE}*(?:{_ID}(?:\.{_ID})*(?:<{_SPACE}*{_ID}(?:\[\])*(?:{_SPACE}*,{_SPACE}*{_ID}(?:\[\])*)*{_SPACE}*>)?(?:\[\])*)(?={_SPACE}*[,)=;{{}}])(?!{_SPACE}*=>)"
).match
_js_params = re.compile(rf"\({_SPACE}*(?:{_ID}(?:{_SPACE}*,{_SPACE}*{_ID})*)?{_SPACE}*\)").match
_import = re.compile(
    rf"import\s+(?:type\s+)?(?:(?:{_ID}\s*,\s*)?(?:\*\s*as\s+{_ID}|\{{\s*(?:{_ID}(?:\s+as\s+{_ID})?(?:\s*,\s*{_ID}(?:\s+as\s+{_ID})?)*\s*,?)?\s*\}})|{_ID})\s*from\s*(?:\"[^\"\\\n\r]*\"|'[^'\\\n\r]*')[ \t]*(?=;|[\r\n]|\Z|//|/\*)"
).match
_jsx_name = re.compile(rf"{_ID}(?:[-.:][\w$-]+)*").match
_jsx_attribute = re.compile(r"[A-Za-z_$][\w$-]*(?::[\w-]+)?").match
_jsx_text = re.compile(r"[^<{}>]*").match
_generic_call = re.compile(rf"<{_SPACE}*[\w$.,\s\[\]|&<>\"'{{}}:;?]*>{_SPACE}*[(`]").match
CONFLICT = re.compile(r"^(?:<{7}(?: |$)|={7}$|>{7}(?: |$)|\|{7}(?: |$))", re.M)
_use = re.compile(r"\s*([({\[]|" + _ID + ")").match

#: Words that cannot name a variable.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return switch throw try typeof var void while with".split()
)
UNARY = frozenset(["typeof", "void", "delete", "await", "yield", "new"])
_LINE = re.compile(r"[\n\r  ]").search
BINARY = frozenset("+ - * / % ** == != === !== < > <= >= && || ?? & | ^ << >> >>> = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
ASSIGNS = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())

# states
(START, NEED, OPERAND, OPERATOR, KEY, AFTER_KEY, BINDING, PARAM, AFTER_PARAM, MEMBER, ENUM_NAME, ATTRIBUTE, CHILD, BODY, BODY_DECLARATION, BODY_EXPRESSION, BODY_METHOD, BODY_MEMBER) = range(18)
GO_ON = {BODY_DECLARATION: START, BODY_EXPRESSION: OPERATOR, BODY_METHOD: OPERATOR, BODY_MEMBER: MEMBER}
# what is open
(TOP, BLOCK, FUNCTION, SWITCH, PAREN, CALL, INDEX, ARRAY, OBJECT, HEAD, FOR, PARAMS, PATTERN_OBJECT, PATTERN_ARRAY, CLASS, ENUM, QUASI, ELEMENT, SLOT, TERNARY, COMPUTED) = range(21)
CLOSER = {PAREN: ")", CALL: ")", INDEX: "]", ARRAY: "]", OBJECT: "}", HEAD: ")", FOR: ")", PARAMS: ")", PATTERN_OBJECT: "}", PATTERN_ARRAY: "]", BLOCK: "}", FUNCTION: "}", SWITCH: "}", CLASS: "}", ENUM: "}", QUASI: "}", SLOT: "}", COMPUTED: "]"}
STATEMENTS = frozenset([TOP, BLOCK, FUNCTION, SWITCH])


class Script:
    """One check of a script; ``error`` is the first place where it is not valid, or None."""

    def __init__(self, text: str, dialect: str):
        self.text = text
        self.typed = dialect in ("ts", "tsx")
        self.markup = dialect in ("tsx", "jsx")
        self.marks: dict[int, tuple[int, str]] = {}  # start: end and kind of what only the automaton can tell apart

    def error(self) -> tuple[int, str] | None:
        limit = sys.getrecursionlimit()
        try:
            return self.outcome()
        except RecursionError:  # only types are read recursively; their depth is bounded by the text
            sys.setrecursionlimit(limit + 8 * len(self.text))
            return self.outcome()
        finally:
            sys.setrecursionlimit(limit)

    def outcome(self) -> tuple[int, str] | None:
        self.marks.clear()
        try:
            self.run()
        except Invalid as e:
            return e.at, e.why
        return None

    # -- types ---------------------------------------------------------------------------------------------------

    def space(self, i: int) -> int:
        return _skip(self.text, i).end()

    def next(self, i: int) -> tuple[str, str, int, int]:
        """The token after white space and comments: kind, text, start, end."""
        i = _skip(self.text, i).end()
        m = _token(self.text, i)
        if m is None:
            if i >= len(self.text):
                return "end", "", i, i
            return "other", self.text[i], i, i + 1
        return m.lastgroup, m.group(), i, m.end()

    def type(self, i: int) -> int:
        """Read a type from ``i``; the place after it."""
        if m := _simple_type(self.text, i):
            return m.end()
        kind, t, at, end = self.next(i)
        if t in ("|", "&"):
            kind, t, at, end = self.next(end)
        while True:
            end = self.type_operand(kind, t, at, end)
            while True:  # suffixes
                kind, t, at, after = self.next(end)
                if t == "[" and not _LINE(self.text, end, at):
                    k2, t2, _, e2 = self.next(after)
                    if t2 == "]":
                        end = e2
                    else:
                        end = self.expect("]", self.type(after))
                elif kind == "name" and t == "is" and not _LINE(self.text, end, at):
                    end = self.type(after)
                else:
                    break
            if t in ("|", "&"):
                kind, t, at, end = self.next(after)
                continue
            if t == "extends" and not _LINE(self.text, end, at):
                end = self.expect("?", self.type(after))
                end = self.expect(":", self.type(end))
                return self.type(end)
            return end

    def expect(self, what: str, i: int) -> int:
        kind, t, at, end = self.next(i)
        if t != what:
            if what == ">" and t.startswith(">"):
                return at + 1
            raise Invalid(at, "unexpected end of file" if kind == "end" else f"'{what}' expected")
        return end

    def type_operand(self, kind: str, t: str, at: int, end: int) -> int:
        text = self.text
        if kind == "name":
            if t in ("keyof", "typeof", "readonly", "unique", "infer", "asserts", "abstract") and (m := _token(text, self.space(end))) and (m.lastgroup in ("name", "string") or m.group() in "([{"):
                k, x, a, e = self.next(end)
                return self.type_operand(k, x, a, e)
            if t == "new":
                return self.type(end)
            if t in RESERVED and t not in ("void", "import"):
                raise Invalid(at, f"unexpected '{t}' in a type")
            if t == "import":
                end = self.expect(")", self.type(self.expect("(", end)))
                k, x, a, e = self.next(end)
                return self.type_reference(e) if x == "." else end
            if text.startswith("<", self.space(end)) and not text.startswith("<<", self.space(end)):
                return self.type_arguments(end)
            return end
        if kind in ("string", "number"):
            return end
        if t == "-":
            return self.next(end)[3]
        if t == "`":
            m = _template(text, end)
            self.marks[at] = m.end(), "template"
            while m.group(1) == "${":
                end = self.expect("}", self.type(m.end()))
                m = _template(text, end)
                self.marks[end - 1] = m.end(), "template"
            if m.group(1) is None:
                raise Invalid(at, "unterminated template")
            return m.end()
        if t == "(":
            return self.type_parens(end)
        if t == "<":
            return self.type_parens(self.expect("(", self.type_parameters(at)))
        if t == "[":
            while True:
                k, x, a, e = self.next(end)
                if x == "]":
                    return e
                if x == "...":
                    end = e
                    k, x, a, e = self.next(end)
                if k == "name" and (y := self.next(e))[1] in (":", "?") and not (y[1] == "?" and self.next(y[3])[1] != ":"):
                    end = self.type(self.next(y[3])[3] if y[1] == "?" else y[3])
                else:
                    end = self.type(end)
                k, x, a, e = self.next(end)
                if x == "?":
                    end = e
                    k, x, a, e = self.next(end)
                if x == ",":
                    end = e
                elif x != "]":
                    raise Invalid(a, "']' expected")
        if t == "{":
            return self.type_members(end)
        raise Invalid(at, "unexpected end of file" if kind == "end" else f"a type expected, found '{t}'")

    def type_arguments(self, i: int) -> int:
        end = self.expect("<", i)
        while True:
            end = self.type(end)
            k, x, a, e = self.next(end)
            if x == ",":
                end = e
            else:
                return self.expect(">", end)

    def type_parameters(self, i: int) -> int:
        end = self.expect("<", i)
        while True:
            k, x, a, e = self.next(end)
            while x in ("const", "in", "out") and self.next(e)[0] == "name":
                k, x, a, e = self.next(e)
            if k != "name" or x in RESERVED:
                raise Invalid(a, "a type parameter expected")
            end = e
            k, x, a, e = self.next(end)
            if x == "extends":
                end = self.type(e)
                k, x, a, e = self.next(end)
            if x == "=":
                end = self.type(e)
                k, x, a, e = self.next(end)
            if x != ",":
                return self.expect(">", end)
            end = e
            if self.next(end)[1] == ">":
                return self.next(end)[3]

    def type_parens(self, i: int) -> int:
        """After '(' in a type: parameters of a function type, or a type in parentheses."""
        end = i
        k, x, a, e = self.next(end)
        if x == ")":
            return self.type(self.expect("=>", e))
        y = self.next(e)
        if x in ("...", "{", "[") and x == "..." or (k == "name" and y[1] in (":", ",", "?", "=>")) or (k == "name" and y[1] == ")" and self.next(y[3])[1] == "=>"):
            while True:
                k, x, a, e = self.next(end)
                if x == ")":
                    return self.type(self.expect("=>", e))
                if x == "...":
                    k, x, a, e = self.next(e)
                if k != "name":
                    raise Invalid(a, "a parameter expected")
                end = e
                k, x, a, e = self.next(end)
                if x == "?":
                    end = e
                    k, x, a, e = self.next(end)
                if x == ":":
                    end = self.type(e)
                    k, x, a, e = self.next(end)
                if x == ",":
                    end = e
                elif x != ")":
                    raise Invalid(a, "')' expected")
        end = self.expect(")", self.type(end))
        k, x, a, e = self.next(end)
        return self.type(e) if x == "=>" else end

    def type_members(self, i: int) -> int:
        """After '{' in a type or an interface: its members, to the '}'."""
        end = i
        while True:
            k, x, a, e = self.next(end)
            if x == "}":
                return e
            if x in (",", ";") :
                end = e
                continue
            while x in ("readonly", "get", "set", "static", "new", "+", "-") and self.next(e)[1] not in (":", "?", "(", ";", ",", "}"):
                k, x, a, e = self.next(e)
            if x == "[":
                k2, x2, a2, e2 = self.next(e)
                y = self.next(e2)
                if k2 == "name" and y[1] == ":":
                    end = self.expect("]", self.type(y[3]))
                elif k2 == "name" and y[1] == "in":
                    end = self.type(y[3])
                    k, x, a, e = self.next(end)
                    if x == "as":
                        end = self.type(e)
                    end = self.expect("]", end)
                else:
                    end = self.expect("]", self.type(e))
            elif x in ("(", "<"):
                end = a
            elif k in ("name", "string", "number"):
                end = e
            else:
                raise Invalid(a, "unexpected end of file" if k == "end" else f"unexpected '{x}' in a type")
            k, x, a, e = self.next(end)
            if x in ("?", "-", "+"):
                end = e
                k, x, a, e = self.next(end)
                if x == "?":
                    end = e
                    k, x, a, e = self.next(end)
            if x == "<":
                end = self.type_parameters(end)
                k, x, a, e = self.next(end)
            if x == "(":
                end = self.parameters_of_type(e)
                k, x, a, e = self.next(end)
            if x == ":":
                end = self.type(e)
                k, x, a, e = self.next(end)
            if x not in (";", ",", "}") and not _LINE(self.text, end, a):
                raise Invalid(a, "unexpected end of file" if k == "end" else f"unexpected '{x}' in a type")

    def parameters_of_type(self, i: int) -> int:
        end = i
        while True:
            k, x, a, e = self.next(end)
            if x == ")":
                return e
            if x == "...":
                k, x, a, e = self.next(e)
            if x in ("{", "["):
                depth, e = 1, e
                while depth:
                    k, x, a, e = self.next(e)
                    if k == "end":
                        raise Invalid(a, "unexpected end of file")
                    depth += (x in "{[") - (x in "}]") if x else 0
            elif k != "name":
                raise Invalid(a, "unexpected end of file" if k == "end" else "a parameter expected")
            end = e
            k, x, a, e = self.next(end)
            if x == "?":
                end = e
                k, x, a, e = self.next(end)
            if x == ":":
                end = self.type(e)
                k, x, a, e = self.next(end)
            if x == ",":
                end = e
            elif x != ")":
                raise Invalid(a, "unexpected end of file" if k == "end" else "')' expected")

    # -- statements and expressions ------------------------------------------------------------------------------

    def run(self) -> None:
        text, typed, markup = self.text, self.typed, self.markup
        skip, token = _skip, _token
        n = len(text)
        i = 2 if text.startswith("#!") else 0
        if i:
            i = (m.start() if (m := _LINE(text)) else n)
        elif text.startswith("﻿"):
            i = 1
        stack: list[tuple] = []  # (kind, where, declares, state, extra) of what encloses the present frame
        frame, opened, declares, extra = TOP, 0, False, None
        state = START
        before = ""  # the token before, where it matters: '(' ',' '[' or a kind
        functions = 0

        def where(kind: str, t: str, at: int) -> Invalid:
            if kind == "end":
                return Invalid(n, f"unexpected end of file, line {text.count(chr(10), 0, opened) + 1} is still open" if stack else "unexpected end of file")
            if t == "`" or t in "\"'":
                return Invalid(at, "unterminated string")
            return Invalid(at, f"unexpected '{t[:40]}'")

        while True:
            if state == CHILD:  # inside an element
                m = _jsx_text(text, i)
                if m.end() > i:
                    self.marks[i] = m.end(), "text"
                i = m.end()
                c = text[i : i + 1]
                if c == "{":
                    stack.append((frame, opened, declares, CHILD, extra))
                    frame, opened, extra, state, before, i = SLOT, i, None, OPERAND, "{", i + 1
                elif c == "<":
                    if text.startswith("</", i):
                        j = skip(text, i + 2).end()
                        m = _jsx_name(text, j)
                        name = m.group() if m else ""
                        self.mark_name(m)
                        if name != extra:
                            raise Invalid(i, f"closing tag of '{extra}' expected")
                        j = skip(text, m.end() if m else j).end()
                        if not text.startswith(">", j):
                            raise Invalid(j, "'>' expected")
                        i = j + 1
                        frame, opened, declares, state, extra = stack.pop()
                    else:
                        j = skip(text, i + 1).end()
                        m = _jsx_name(text, j)
                        stack.append((frame, opened, declares, CHILD, extra))
                        frame, opened, extra, state = ELEMENT, i, m.group() if m else "", ATTRIBUTE
                        self.mark_name(m)
                        i = m.end() if m else j
                else:
                    raise Invalid(i, f"unexpected '{c}' in markup" if c else f"unexpected end of file, tag '{extra}' is still open")
                continue
            i = skip(text, i).end()
            if state == ATTRIBUTE:
                if text.startswith("/>", i):
                    i += 2
                    frame, opened, declares, state, extra = stack.pop()
                elif text.startswith(">", i):
                    i, state = i + 1, CHILD
                elif text.startswith("{", i):
                    stack.append((frame, opened, declares, ATTRIBUTE, extra))
                    frame, opened, extra, state, before, i = SLOT, i, None, OPERAND, "", i + 1
                    j = skip(text, i).end()
                    if not text.startswith("...", j):
                        raise Invalid(j, "'...' expected")
                    i = j + 3
                else:
                    m = _jsx_attribute(text, i)
                    if not m:
                        raise Invalid(i, f"unexpected '{text[i : i + 1]}' in a tag" if i < n else "unexpected end of file")
                    self.marks[m.start()] = m.end(), "attribute"
                    i = skip(text, m.end()).end()
                    if text.startswith("=", i):
                        i = skip(text, i + 1).end()
                        if text.startswith("{", i):
                            stack.append((frame, opened, declares, ATTRIBUTE, extra))
                            frame, opened, extra, state, before, i = SLOT, i, None, OPERAND, "", i + 1
                        else:
                            quote = text[i : i + 1]
                            j = text.find(quote, i + 1) if quote and quote in "\"'" else -1
                            if j < 0:
                                raise Invalid(i, "unterminated string" if quote and quote in "\"'" else "a value expected")
                            self.marks[i] = j + 1, "string"
                            i = j + 1
                continue

            m = token(text, i)
            if m is None:
                if i < n:
                    raise Invalid(i, "unterminated string" if text[i] in "\"'" else "unterminated comment" if text.startswith("/*", i) else f"unexpected character '{text[i]}'")
                kind, t, end = "end", "", i
            else:
                kind, t, end = m.lastgroup, m.group(), m.end()
                if kind == "punct" and t == "/" and text.startswith("/*", i):
                    raise Invalid(i, "unterminated comment")

            if state == OPERATOR:
                if kind == "punct":
                    if t == "(":
                        stack.append((frame, opened, declares, OPERATOR, extra))
                        frame, opened, declares, extra, state, before = CALL, i, False, None, OPERAND, "("
                    elif t == ")":
                        if frame == CALL or frame == PAREN:
                            was = frame, extra
                            frame, opened, declares, state, extra = stack.pop()
                            state, before = OPERATOR, ")"
                            if was[1] == "arrow":  # annotated parameters: an arrow has to follow
                                j = skip(text, end).end()
                                if text.startswith(":", j):
                                    j = skip(text, self.type(j + 1)).end()
                                if not text.startswith("=>", j):
                                    raise Invalid(j, "'=>' expected")
                                end = j
                            elif typed and was[0] == PAREN and text.startswith(":", j := skip(text, end).end()) and frame != TERNARY:
                                try:
                                    k = skip(text, self.type(j + 1)).end()
                                    if text.startswith("=>", k):
                                        end = k
                                except Invalid:
                                    pass
                        elif frame == HEAD or frame == FOR:
                            if frame == FOR and extra not in ("each", 2):
                                raise where(kind, t, i)
                            frame, opened, declares, state, extra = stack.pop()
                            state = NEED if state != BODY else BODY
                        elif frame == PARAMS:
                            after = extra
                            frame, opened, declares, state, extra = stack.pop()
                            end, state = self.after_parameters(end, after)
                            before = ""
                        else:
                            raise where(kind, t, i)
                    elif t == ",":
                        before = ","
                        if declares:
                            state = BINDING
                        elif frame in (CALL, PAREN, ARRAY, INDEX) or frame in STATEMENTS or frame in (HEAD, FOR, QUASI):
                            state = OPERAND
                        elif frame == OBJECT:
                            state = KEY
                        elif frame == PARAMS:
                            state = PARAM
                        elif frame == PATTERN_OBJECT:
                            state = KEY
                        elif frame == PATTERN_ARRAY:
                            state = BINDING
                        elif frame == ENUM:
                            state = ENUM_NAME
                        else:
                            raise where(kind, t, i)
                    elif t == ";":
                        if frame in STATEMENTS:
                            state, declares = START, False
                        elif frame == FOR and extra in (0, 1):
                            extra += 1
                            state, before, declares = OPERAND, ";", False
                        elif frame == CLASS:
                            state = MEMBER
                        else:
                            raise where(kind, t, i)
                    elif t == "=>":
                        j = skip(text, end).end()
                        if before not in (")", "name"):
                            raise where(kind, t, i)
                        if text.startswith("{", j):
                            stack.append((frame, opened, declares, OPERATOR, extra))
                            frame, opened, declares, extra, state, functions = FUNCTION, j, False, OPERATOR, START, functions + 1
                            end = j + 1
                        else:
                            state, before = OPERAND, "=>"
                    elif t == "}":
                        if frame in STATEMENTS:
                            state, declares = START, False
                            continue
                        if frame == OBJECT or frame == PATTERN_OBJECT:
                            kind_was, to = frame, extra
                            frame, opened, declares, state, extra = stack.pop()
                            state = to
                            before = "}"
                        elif frame == SLOT:
                            frame, opened, declares, state, extra = stack.pop()
                        elif frame == QUASI:
                            frame, opened, declares, state, extra = stack.pop()
                            end = self.quasi(end, opened)
                            if text[end - 1] == "{":
                                stack.append((frame, opened, declares, OPERATOR, extra))
                                frame, opened, declares, extra, state, before = QUASI, end - 2, False, None, OPERAND, ""
                            else:
                                state = OPERATOR
                        elif frame == ENUM:
                            frame, opened, declares, state, extra = stack.pop()
                            state = START
                        elif frame == CLASS:
                            state = MEMBER
                            continue
                        else:
                            raise where(kind, t, i)
                    elif t == "]":
                        if frame == INDEX or frame == ARRAY:
                            frame, opened, declares, state, extra = stack.pop()
                            state, before = OPERATOR, "]"
                        elif frame == PATTERN_ARRAY:
                            to = extra
                            frame, opened, declares, state, extra = stack.pop()
                            state = to
                        elif frame == COMPUTED:
                            frame, opened, declares, state, extra = stack.pop()
                        else:
                            raise where(kind, t, i)
                    elif t == "[":
                        stack.append((frame, opened, declares, OPERATOR, extra))
                        frame, opened, declares, extra, state, before = INDEX, i, False, None, OPERAND, ""
                    elif t == "?":
                        if typed and frame == PAREN and text[skip(text, end).end() :][:1] in (":", ",", ")"):
                            extra = "arrow"
                            j = skip(text, end).end()
                            end = self.type(j + 1) if text[j] == ":" else end
                        else:
                            stack.append((frame, opened, declares, OPERATOR, extra))
                            frame, opened, declares, extra, state, before = TERNARY, i, False, None, OPERAND, ""
                    elif t == ":":
                        if frame == TERNARY:
                            frame, opened, declares, state, extra = stack.pop()
                            state, before = OPERAND, ":"
                        elif frame in STATEMENTS and extra == "case":
                            extra, state = None, START
                        elif frame in STATEMENTS and before == "name" and not declares:
                            state = START  # a label
                        elif typed and frame == PAREN and before in ("name", "}", "]"):
                            extra, end = "arrow", self.type(end)
                            before = ""
                        else:
                            raise where(kind, t, i)
                    elif t == "`":
                        end = self.quasi(end, i)
                        if text[end - 1] == "{":
                            stack.append((frame, opened, declares, OPERATOR, extra))
                            frame, opened, declares, extra, state, before = QUASI, i, False, None, OPERAND, ""
                    elif t == "++" or t == "--":
                        before = ""
                    elif t == "!" and typed:
                        before = "!"
                    elif t in (".", "?."):
                        j = skip(text, end).end()
                        if t == "?." and text[j : j + 1] in ("(", "["):
                            pass
                        else:
                            m = token(text, j + 1 if text.startswith("#", j) else j)
                            if not m or m.lastgroup != "name":
                                raise where(kind, t, i)
                            end = m.end()
                        before = ""
                    elif t == "<" and typed and (m := _generic_call(text, i)) and self.generic(i):
                        end = self.type_arguments(i)
                    elif t == "#":
                        raise where(kind, t, i)
                    elif t in BINARY:
                        state, before = OPERAND, t
                    elif t == "{" and frame in STATEMENTS and _LINE(text, opened, i) and self.broken(i):
                        state, declares = START, False
                        continue
                    elif t == "@" and (frame == CLASS or self.broken(i)):
                        state = MEMBER if frame == CLASS else START
                        continue
                    else:
                        raise where(kind, t, i)
                    i = end
                    continue
                if kind == "name":
                    if t == "in" or t == "instanceof":
                        if declares and frame == FOR and t == "in":
                            declares, extra = False, "each"
                        elif frame == FOR and t == "in" and extra == 0:
                            extra = "each"
                        state, before, i = OPERAND, t, end
                        continue
                    if t == "of" and frame == FOR:
                        declares, extra, state, before, i = False, "each", OPERAND, "of", end
                        continue
                    if typed and t in ("as", "satisfies") and not self.broken(i):
                        j = skip(text, end).end()
                        i = self.type(end) if not text.startswith("const", j) else j + 5
                        before = ""
                        continue
                if kind == "end" and frame == TOP:
                    return
                if frame in STATEMENTS and kind != "end" and self.broken(i):
                    state, declares = START, False
                    continue
                if frame == CLASS and kind != "end" and self.broken(i):
                    state = MEMBER
                    continue
                raise where(kind, t, i)

            if state == OPERAND:
                if kind == "name":
                    if "." in t:
                        root = t[: t.index(".")].rstrip("?")
                        if root in RESERVED and root not in ("import", "new"):
                            raise where(kind, root, i)
                        state, before = OPERATOR, ""
                        if root == "new" and t != "new.target":
                            raise where(kind, t, i)
                    elif t in UNARY:
                        before = t
                        if t == "yield" and text.startswith("*", j := skip(text, end).end()):
                            end = j + 1
                        elif t in ("await", "yield") and (text[(j := skip(text, end).end()) : j + 1] in (")", ";", ",", "}", "]", ":", "") or _LINE(text, end, j)):
                            state = OPERATOR
                    elif t == "function":
                        i, state, frame, opened, declares, extra, functions = self.function(end, stack, frame, opened, declares, extra, functions, OPERATOR)
                        continue
                    elif t == "class":
                        end = self.class_head(end, i)
                        stack.append((frame, opened, declares, OPERATOR, extra))
                        frame, opened, declares, extra, state = CLASS, i, False, OPERATOR, MEMBER
                    elif t == "async" and (m := token(text, skip(text, end).end())) and m.lastgroup == "name" and not _LINE(text, end, m.start()):
                        before = "async"
                    elif t == "async" and typed and text.startswith("<", j := skip(text, end).end()):
                        end = self.type_parameters(j)
                    elif t in RESERVED and t != "import":
                        raise where(kind, t, i)
                    else:
                        state, before = OPERATOR, "name"
                    i = end
                elif kind == "number" or kind == "string":
                    state, before, i = OPERATOR, "", end
                elif kind == "punct":
                    if t == "(":
                        stack.append((frame, opened, declares, OPERATOR, extra))
                        frame, opened, declares, extra, before = PAREN, i, False, None, "("
                    elif t == "{":
                        stack.append((frame, opened, declares, OPERATOR, extra))
                        frame, opened, declares, extra, state = OBJECT, i, False, OPERATOR, KEY
                    elif t == "[":
                        stack.append((frame, opened, declares, OPERATOR, extra))
                        frame, opened, declares, extra, before = ARRAY, i, False, None, "["
                    elif t in ("+", "-", "!", "~", "++", "--"):
                        before = t
                    elif t == "...":
                        if frame not in (CALL, ARRAY, PAREN, OBJECT):
                            raise where(kind, t, i)
                        before = t
                    elif t == "`":
                        end = self.quasi(end, i)
                        if text[end - 1] == "{":
                            stack.append((frame, opened, declares, OPERATOR, extra))
                            frame, opened, declares, extra, before = QUASI, i, False, None, ""
                        else:
                            state, before = OPERATOR, ""
                    elif t == "/" or t == "/=":
                        m = _regex(text, i)
                        if not m:
                            raise Invalid(i, "unterminated regular expression")
                        flags = m.group(1)
                        if len(set(flags)) != len(flags) or set(flags) - set("dgimsuvy"):
                            raise Invalid(i, "invalid regular expression flags")
                        self.marks[i] = m.end(), "regex"
                        end, state, before = m.end(), OPERATOR, ""
                    elif t == ")":
                        if frame == CALL and before in ("(", ","):
                            frame, opened, declares, state, extra = stack.pop()
                            state, before = OPERATOR, ")"
                        elif frame == PAREN and (before == "(" or before == ","):
                            was = extra
                            frame, opened, declares, state, extra = stack.pop()
                            j = skip(text, end).end()
                            if typed and text.startswith(":", j):
                                j = skip(text, self.type(j + 1)).end()
                            if not text.startswith("=>", j):
                                raise where(kind, t, i)
                            end, state, before = j, OPERATOR, ")"
                        elif frame == FOR and extra == 2 and before == ";":
                            frame, opened, declares, state, extra = stack.pop()
                            state = NEED
                        else:
                            raise where(kind, t, i)
                    elif t == "]":
                        if frame == ARRAY and before in ("[", ","):
                            frame, opened, declares, state, extra = stack.pop()
                            state, before = OPERATOR, "]"
                        else:
                            raise where(kind, t, i)
                    elif t == "," and frame == ARRAY and before in ("[", ","):
                        before = ","
                    elif t == ";":
                        if before == "return" or before == "yield":
                            state, declares = (START, False) if frame in STATEMENTS else (OPERATOR, declares)
                        elif frame == FOR and extra in (0, 1) and before in ("(", ";"):
                            extra += 1
                            before = ";"
                        else:
                            raise where(kind, t, i)
                    elif t == "}":
                        if before == "return" and frame in STATEMENTS:
                            state = START
                            continue
                        if frame == SLOT and before == "{":
                            frame, opened, declares, state, extra = stack.pop()
                        else:
                            raise where(kind, t, i)
                    elif t == "<" and markup:
                        j = skip(text, end).end()
                        if typed and (m := re.compile(rf"{_ID}\s*(?:,|extends\b)").match(text, j)):
                            end = self.type_parameters(i)
                        else:
                            m = _jsx_name(text, j)
                            self.mark_name(m)
                            stack.append((frame, opened, declares, OPERATOR, extra))
                            frame, opened, extra, state = ELEMENT, i, m.group() if m else "", ATTRIBUTE
                            end = m.end() if m else j
                            if not m and not text.startswith(">", j):
                                raise where(kind, t, i)
                    elif t == "<" and typed:
                        end = self.expect(">", self.type(end)) if not re.compile(rf"<\s*{_ID}\s*(?:,|extends\b|=)").match(text, i) else self.type_parameters(i)
                    elif t == "#" and (m := token(text, end)) and m.lastgroup == "name":
                        end, state = m.end(), OPERATOR
                    elif t == "@" and re.compile(r"@[\w$.]+").match(text, i):
                        end = re.compile(r"@[\w$.]+").match(text, i).end()
                    else:
                        raise where(kind, t, i)
                    i = end
                else:
                    if before == "return" and frame == TOP:
                        return
                    raise where(kind, t, i)
                continue

            if state == START or state == NEED:
                if kind == "punct":
                    if t == "{":
                        stack.append((frame, opened, declares, START, extra))
                        frame, opened, declares, extra, state, i = BLOCK, i, False, None, START, end
                        continue
                    if t == "}":
                        if state == NEED or extra == "case":
                            raise where(kind, t, i)
                        if frame == TOP:
                            raise Invalid(i, "'}' without a block")
                        if frame == FUNCTION:
                            functions -= 1
                        was, to = frame, extra
                        frame, opened, declares, state, extra = stack.pop()
                        if was == FUNCTION:
                            state = to if to is not None and to != "case" else START
                            before = "}"
                        i = end
                        continue
                    if t == ";":
                        state, i = START, end
                        continue
                    if t == "@":
                        m = re.compile(r"@[\w$.]+").match(text, i)
                        if not m:
                            raise where(kind, t, i)
                        i = m.end()
                        if text.startswith("(", i):
                            i = self.balanced(i)
                        continue
                    state, before = OPERAND, "start"
                    continue
                if kind == "end":
                    if frame == TOP and state == START:
                        return
                    raise where(kind, t, i)
                if kind != "name" or "." in t:
                    if kind == "name" and t.split(".")[0] in ("const", "let", "var"):
                        raise where(kind, t, i)
                    state, before = OPERAND, "start"
                    continue
                if t in ("if", "while", "with"):
                    j = skip(text, end).end()
                    if not text.startswith("(", j):
                        raise Invalid(j, f"'(' expected after '{t}'")
                    stack.append((frame, opened, declares, NEED, extra))
                    frame, opened, declares, extra, state, before, i = HEAD, j, False, None, OPERAND, "", j + 1
                    if t == "while":
                        stack[-1] = (*stack[-1][:3], NEED, stack[-1][4])
                elif t == "for":
                    j = skip(text, end).end()
                    if text.startswith("await", j):
                        j = skip(text, j + 5).end()
                    if not text.startswith("(", j):
                        raise Invalid(j, "'(' expected after 'for'")
                    stack.append((frame, opened, declares, NEED, extra))
                    frame, opened, declares, extra, state, before, i = FOR, j, False, 0, OPERAND, "(", j + 1
                    if m := re.compile(r"(?:const|let|var)\b(?!\s*\.)").match(text, j2 := skip(text, i).end()):
                        declares, state, i = True, BINDING, m.end()
                elif t == "switch":
                    j = skip(text, end).end()
                    if not text.startswith("(", j):
                        raise Invalid(j, "'(' expected after 'switch'")
                    stack.append((frame, opened, declares, BODY, extra))
                    frame, opened, declares, extra, state, before, i = HEAD, j, False, "switch", OPERAND, "", j + 1
                elif t in ("else", "do"):
                    state, i = NEED, end
                elif t in ("try", "finally"):
                    j = skip(text, end).end()
                    if not text.startswith("{", j):
                        raise Invalid(j, "'{' expected")
                    i, state = j, START
                elif t == "catch":
                    j = skip(text, end).end()
                    if text.startswith("(", j):
                        m = re.compile(rf"\(\s*(?:{_ID}|\{{[\w\s,:$]*\}}|\[[\w\s,$]*\])\s*").match(text, j)
                        if not m:
                            raise where(kind, t, j)
                        j = m.end()
                        if typed and text.startswith(":", j):
                            j = skip(text, self.type(j + 1)).end()
                        if not text.startswith(")", j):
                            raise Invalid(j, "')' expected")
                        j = skip(text, j + 1).end()
                    if not text.startswith("{", j):
                        raise Invalid(j, "'{' expected")
                    i, state = j, START
                elif t in ("return", "throw"):
                    if t == "return" and not functions:
                        raise Invalid(i, "'return' outside a function")
                    j = skip(text, end).end()
                    if t == "return" and _LINE(text, end, j):
                        state = START
                    else:
                        state, before = OPERAND, t
                    i = end
                elif t in ("break", "continue", "debugger"):
                    m = re.compile(rf"[ \t]+{_ID}").match(text, end) if t != "debugger" else None
                    if m and m.group().strip() in RESERVED:
                        m = None
                    i, state, before = m.end() if m else end, OPERATOR, ""
                elif t in ("const", "let", "var"):
                    j = skip(text, end).end()
                    if t == "const" and typed and (m := re.compile(r"enum\b").match(text, j)):
                        i = j
                        continue
                    if t == "let" and not _use(text, j):
                        state, before = OPERAND, "start"
                        continue
                    declares, state, i = True, BINDING, end
                elif t == "function" or t == "async" and (m := re.compile(r"async[ \t]+function\b").match(text, i)):
                    i, state, frame, opened, declares, extra, functions = self.function(end if t == "function" else m.end(), stack, frame, opened, declares, extra, functions, None)
                elif t == "class" or typed and t == "abstract" and (m := re.compile(r"abstract\s+class\b").match(text, i)):
                    e = self.class_head(end if t == "class" else m.end(), i)
                    stack.append((frame, opened, declares, START, extra))
                    frame, opened, declares, extra, state, i = CLASS, i, False, START, MEMBER, e
                elif t == "import":
                    j = skip(text, end).end()
                    if text[j : j + 1] in ("(", "."):
                        state, before = OPERAND, "start"
                        continue
                    i = self.import_(i)
                    state, before = OPERATOR, ""
                elif t == "export":
                    i, state, extra_state = self.export_(i, end)
                    if extra_state:
                        before = "start"
                elif t in ("case", "default"):
                    if frame != SWITCH:
                        raise where(kind, t, i)
                    if t == "default":
                        i, state = self.expect(":", end), START
                    else:
                        extra, state, before, i = "case", OPERAND, "", end
                elif typed and t in ("interface", "type", "enum", "namespace", "module", "declare") and (m := re.compile(rf"[ \t]+({_ID}(?:\.{_ID})*|\"[^\"\n]*\"|'[^'\n]*')").match(text, end)):
                    if t == "declare":
                        i = end
                        j = skip(text, end).end()
                        if text.startswith("global", j):
                            i = j + 6
                        continue
                    i, opened_enum = self.typed_declaration(t, m.end())
                    state = START
                    if opened_enum == "enum":
                        stack.append((frame, opened, declares, START, extra))
                        frame, opened, declares, extra, state = ENUM, i, False, None, ENUM_NAME
                    elif opened_enum == "block":
                        pass
                    elif opened_enum == "alias":
                        state, before = OPERATOR, ""
                elif t == "enum":
                    raise where(kind, t, i)
                else:
                    state, before = OPERAND, "start"
                continue

            if state == BINDING:
                if kind == "name" and "." not in t and t not in RESERVED:
                    j = skip(text, end).end()
                    c = text[j : j + 1]
                    if typed and c == "!":
                        j = skip(text, j + 1).end()
                        c = text[j : j + 1]
                    if c == ":" and typed and (declares or frame == PARAMS):
                        end = self.type(j + 1)
                        j = skip(text, end).end()
                        c = text[j : j + 1]
                    if c == "=" and text[j : j + 2] not in ("==", "=>"):
                        state, before, i = OPERAND, "=", j + 1
                    else:
                        state, before, i = OPERATOR, "", end
                        c2 = text[j : j + 1]
                        if c2 and c2 not in ",;)}]" and not (frame == FOR and re.compile(r"(?:of|in)\b").match(text, j)) and not _LINE(text, end, j):
                            raise Invalid(j, f"unexpected '{c2}'")
                elif t == "{":
                    stack.append((frame, opened, declares, state, extra))
                    frame, opened, declares, extra, state, i = PATTERN_OBJECT, i, False, AFTER_PARAM, KEY, end
                elif t == "[":
                    stack.append((frame, opened, declares, state, extra))
                    frame, opened, declares, extra, state, i = PATTERN_ARRAY, i, False, AFTER_PARAM, BINDING, end
                elif t == "..." and frame in (PATTERN_ARRAY, PATTERN_OBJECT):
                    i = end
                elif frame == PATTERN_ARRAY and t in (",", "]"):
                    if t == "]":
                        state = OPERATOR
                    else:
                        i = end
                else:
                    raise where(kind, t, i)
                continue

            if state == PARAM:
                if t == ")":
                    if frame != PARAMS:
                        raise where(kind, t, i)
                    after = extra
                    frame, opened, declares, state, extra = stack.pop()
                    i, state = self.after_parameters(end, after)
                    before = ""
                elif t == "...":
                    i = end
                elif t == "@":
                    m = re.compile(r"@[\w$.]+").match(text, i)
                    i = m.end() if m else i + 1
                    if text.startswith("(", i):
                        i = self.balanced(i)
                elif kind == "name" and typed and t in ("public", "private", "protected", "readonly", "override") and (m := token(text, skip(text, end).end())) and m.lastgroup == "name":
                    i = end
                elif kind == "name" and "." not in t and (t not in RESERVED):
                    i, state = end, AFTER_PARAM
                elif t == "{":
                    stack.append((frame, opened, declares, state, extra))
                    frame, opened, declares, extra, state, i = PATTERN_OBJECT, i, False, AFTER_PARAM, KEY, end
                elif t == "[":
                    stack.append((frame, opened, declares, state, extra))
                    frame, opened, declares, extra, state, i = PATTERN_ARRAY, i, False, AFTER_PARAM, BINDING, end
                else:
                    raise where(kind, t, i)
                continue

            if state == AFTER_PARAM:
                if frame == PARAMS:
                    if typed and t == "?":
                        i = end
                        kind, t, i, end = self.next(i)
                        if t not in (":", ",", ")"):
                            raise where(kind, t, i)
                    if typed and t == ":":
                        i = self.type(end)
                        kind, t, i, end = self.next(i)
                    if t == "=":
                        state, before, i = OPERAND, "=", end
                    elif t == ",":
                        state, i = PARAM, end
                    elif t == ")":
                        after = extra
                        frame, opened, declares, state, extra = stack.pop()
                        i, state = self.after_parameters(end, after)
                        before = ""
                    else:
                        raise where(kind, t, i)
                else:  # after a pattern that declares variables
                    if typed and t == ":" and declares:
                        i = self.type(end)
                        kind, t, i, end = self.next(i)
                    if t == "=":
                        state, before, i = OPERAND, "=", end
                    elif frame == FOR and t in ("of", "in"):
                        state = OPERATOR
                    elif frame in (PATTERN_ARRAY, PATTERN_OBJECT) and t in (",", "]", "}"):
                        state = OPERATOR
                    else:
                        raise where(kind, t, i)
                continue

            if state == KEY:  # of an object or a pattern
                if t == "}":
                    to = extra
                    frame, opened, declares, state, extra = stack.pop()
                    state, before, i = to, "}", end
                elif t == "...":
                    state, before, i = OPERAND, "...", end
                elif t == "[":
                    stack.append((frame, opened, declares, AFTER_KEY, extra))
                    frame, opened, declares, extra, state, before, i = COMPUTED, i, False, None, OPERAND, "", end
                elif kind in ("name", "string", "number") and "." not in t[: len(t) if kind == "name" else 0]:
                    if kind == "name" and t in ("get", "set", "async", "static") and (y := self.next(end))[0] in ("name", "string", "number") or t in ("get", "set", "async") and self.next(end)[1] in ("[", "*"):
                        i = end
                        continue
                    state, i, before = AFTER_KEY, end, kind if t not in RESERVED else "reserved"
                elif t == "*" and frame == OBJECT:
                    i = end
                elif t == "#" and frame == OBJECT:
                    raise where(kind, t, i)
                else:
                    raise where(kind, t, i)
                continue

            if state == AFTER_KEY:
                if t == ":":
                    state, before, i = (OPERAND if frame == OBJECT else BINDING), ":", end
                elif t == "," and before == "name":
                    state, i = KEY, end
                elif t == "}" and before == "name":
                    state = OPERATOR
                elif t == "=" and before == "name":
                    state, before, i = OPERAND, "=", end
                elif (t == "(" or typed and t == "<") and frame == OBJECT:
                    if t == "<":
                        end = self.expect("(", self.type_parameters(i))
                    stack.append((frame, opened, declares, OPERATOR, extra))
                    frame, opened, declares, extra, state, i = PARAMS, i, False, "method", PARAM, end
                else:
                    raise where(kind, t, i)
                continue

            if state == BODY:  # the body that has to follow
                if t != "{":
                    raise where(kind, t, i)
                stack.append((frame, opened, declares, START, extra))
                frame, opened, declares, extra, state, i = SWITCH, i, False, None, START, end
                j = skip(text, i).end()
                if not re.compile(r"case\b|default\b|\}").match(text, j):
                    raise Invalid(j, "'case' expected" if j < n else "unexpected end of file")
                continue

            if state == MEMBER:
                if t == "}":
                    to = extra
                    frame, opened, declares, state, extra = stack.pop()
                    state, before, i = to, "}", end
                    continue
                if t == ";":
                    i = end
                    continue
                if t == "@":
                    m = re.compile(r"@[\w$.]+").match(text, i)
                    i = m.end() if m else i + 1
                    if text.startswith("(", i):
                        i = self.balanced(i)
                    continue
                if t == "*":
                    i = end
                    continue
                if kind == "name" and t in ("static", "get", "set", "async", *(("public", "private", "protected", "readonly", "abstract", "declare", "override", "accessor") if typed else ())):
                    y = self.next(end)
                    if t == "static" and y[1] == "{":
                        stack.append((frame, opened, declares, MEMBER, extra))
                        frame, opened, declares, extra, state, i, functions = FUNCTION, y[2], False, MEMBER, START, y[3], functions + 1
                        continue
                    if y[0] in ("name", "string", "number") or y[1] in ("[", "#", "*", "{"):
                        i = end
                        continue
                if t == "[":
                    if typed and (m := re.compile(rf"\[\s*{_ID}\s*:").match(text, i)):
                        i = self.type(self.expect(":", self.expect("]", self.type(m.end()))))
                        state, before = OPERATOR, ""
                        continue
                    i = self.balanced(i)
                elif t == "#":
                    m = token(text, end)
                    if not m or m.lastgroup != "name":
                        raise where(kind, t, i)
                    i = m.end()
                elif kind in ("string", "number") or kind == "name" and "." not in t:
                    i = end
                else:
                    raise where(kind, t, i)
                kind, t, i, end = self.next(i)
                if typed and t in ("?", "!"):
                    kind, t, i, end = self.next(end)
                if typed and t == "<":
                    kind, t, i, end = self.next(self.type_parameters(i))
                if t == "(":
                    stack.append((frame, opened, declares, MEMBER, extra))
                    frame, opened, declares, extra, state, i = PARAMS, i, False, "member", PARAM, end
                    continue
                if typed and t == ":":
                    last = self.type(end)
                    kind, t, i, end = self.next(last)
                if t == "=":
                    state, before, i = OPERAND, "=", end
                elif t in (";", "}") or self.broken(i):
                    state = MEMBER
                else:
                    raise where(kind, t, i)
                continue

            if state == ENUM_NAME:
                if t == "}":
                    frame, opened, declares, state, extra = stack.pop()
                    state, i = START, end
                elif kind in ("name", "string") and "." not in (t if kind == "name" else ""):
                    i = end
                    kind, t, i, end = self.next(i)
                    if t == "=":
                        state, before, i = OPERAND, "=", end
                    elif t == ",":
                        i = end
                    elif t != "}":
                        raise where(kind, t, i)
                else:
                    raise where(kind, t, i)
                continue

            if t != "{":  # a function body has to follow
                raise where(kind, t, i)
            stack.append((frame, opened, declares, START, extra))
            frame, opened, declares, extra, state, i, functions = FUNCTION, i, False, GO_ON[state], START, end, functions + 1

    # -- helpers of run -------------------------------------------------------------------------------------------

    def broken(self, i: int) -> bool:
        """Is there a line break in the white space and comments just before ``i``?"""
        text = self.text
        j = i
        while j > 0 and text[j - 1] in " \t\n\r﻿   ":
            j -= 1
            if text[j] in "\n\r  ":
                return True
        if j > 1 and text.startswith("*/", j - 2):
            k = text.rfind("/*", 0, j - 2)
            return k >= 0 and (bool(_LINE(text, k, j)) or self.broken(k))
        return j == 0

    def quasi(self, i: int, opened: int) -> int:
        """Template text from ``i``; the place after the closing quote or after '${'."""
        m = _template(self.text, i)
        if m.group(1) is None:
            raise Invalid(opened, "unterminated template")
        self.marks[i - 1] = m.end(), "template"
        return m.end()

    def mark_name(self, m: re.Match | None) -> None:
        """An element's name: a name on its own is a reference if it begins large or has a dot, else a word of markup."""
        if m and not (m.group()[0].isupper() or "." in m.group()):
            self.marks[m.start()] = m.end(), "element"

    def generic(self, i: int) -> bool:
        try:
            j = self.type_arguments(i)
        except Invalid:
            return False
        return self.text[self.space(j) :][:1] in ("(", "`")

    def balanced(self, i: int) -> int:
        """From an opening bracket to after its closing one (arguments of decorators, computed names)."""
        open_: list[str] = []
        while True:
            kind, t, at, end = self.next(i)
            if kind == "end" or kind == "other":
                raise Invalid(at, "unexpected end of file" if kind == "end" else f"unexpected '{t}'")
            if t in ("(", "[", "{"):
                open_.append({"(": ")", "[": "]", "{": "}"}[t])
            elif t in (")", "]", "}"):
                if not open_ or open_.pop() != t:
                    raise Invalid(at, f"unexpected '{t}'")
                if not open_:
                    return end
            i = end

    def function(self, i, stack, frame, opened, declares, extra, functions, after):
        """After 'function': its name and type parameters, then the parameter list is opened."""
        kind, t, at, end = self.next(i)
        if t == "*":
            kind, t, at, end = self.next(end)
        if kind == "name" and "." not in t and t not in RESERVED:
            kind, t, at, end = self.next(end)
        elif after is None and t != "(":
            raise Invalid(at, "a name expected after 'function'")
        if t == "<" and self.typed:
            kind, t, at, end = self.next(self.type_parameters(at))
        if t != "(":
            raise Invalid(at, "unexpected end of file" if kind == "end" else f"'(' expected, found '{t}'")
        stack.append((frame, opened, declares, START, extra))
        return end, PARAM, PARAMS, at, False, "expression" if after is not None else "declaration", functions

    def after_parameters(self, i: int, what: str) -> tuple[int, int]:
        """After the ')' of a parameter list: a return type, and the body that has to follow."""
        kind, t, at, end = self.next(i)
        if self.typed and t == ":":
            i = self.type(end)
            kind, t, at, end = self.next(i)
        if t != "{":
            if self.typed and what in ("declaration", "member") and (t in (";", "}") or self.broken(at) or kind == "end"):
                return i, (START if what == "declaration" else MEMBER)
            raise Invalid(at, "unexpected end of file" if kind == "end" else f"'{{' expected, found '{t}'")
        return at, {"declaration": BODY_DECLARATION, "expression": BODY_EXPRESSION, "method": BODY_METHOD, "member": BODY_MEMBER}[what]

    def class_head(self, i: int, opened: int) -> int:
        """After 'class': name, heritage; the place after '{'."""
        kind, t, at, end = self.next(i)
        if kind == "name" and t not in ("extends", "implements") and "." not in t and t not in RESERVED:
            kind, t, at, end = self.next(end)
            if self.typed and t == "<":
                kind, t, at, end = self.next(self.type_parameters(at))
        if t == "extends":
            kind, t, at, end = self.next(end)
            if kind != "name":
                raise Invalid(at, "a class expected after 'extends'")
            kind, t, at, end = self.next(end)
            while t in ("(", "["):
                kind, t, at, end = self.next(self.balanced(at))
            if self.typed and t == "<":
                kind, t, at, end = self.next(self.type_arguments(at))
        if self.typed and t == "implements":
            while True:
                kind, t, at, end = self.next(self.type(end))
                if t != ",":
                    break
        if t != "{":
            raise Invalid(at, "unexpected end of file" if kind == "end" else f"'{{' expected, found '{t}'")
        return end

    def import_(self, i: int) -> int:
        text = self.text
        m = _import(text, i)
        if m and (self.typed or not re.match(r"import\s+type\s+[\w${*]", m.group()) or re.match(r"import\s+type\s+from\b|import\s+type\s*,", m.group())):
            return m.end()
        kind, t, at, end = self.next(i + 6)
        if kind == "string":
            return end
        if self.typed and kind == "name" and (y := self.next(end))[1] == "=":
            kind, t, at, end = self.next(y[3])
            if kind != "name":
                raise Invalid(at, "a module expected")
            return self.balanced(self.space(end)) if t == "require" else end
        if self.typed and t == "type" and self.next(end)[0] == "name" and self.next(end)[1] != "from" or self.typed and t == "type" and self.next(end)[1] in ("{", "*"):
            kind, t, at, end = self.next(end)
        if kind == "name" and t not in RESERVED:
            kind, t, at, end = self.next(end)
            if t == ",":
                kind, t, at, end = self.next(end)
            elif t != "from":
                raise Invalid(at, "'from' expected")
        if t == "*":
            kind, t, at, end = self.next(self.expect("as", end))
            if kind != "name":
                raise Invalid(at, "a name expected")
            kind, t, at, end = self.next(end)
        elif t == "{":
            kind, t, at, end = self.next(self.specifiers(end))
        if t != "from":
            raise Invalid(at, "unexpected end of file" if kind == "end" else f"'from' expected, found '{t}'")
        kind, t, at, end = self.next(end)
        if kind != "string":
            raise Invalid(at, "a module expected")
        kind, t, at, e2 = self.next(end)
        if t in ("with", "assert") and self.next(e2)[1] == "{":
            return self.balanced(self.next(e2)[2])
        return end

    def specifiers(self, i: int) -> int:
        while True:
            kind, t, at, end = self.next(i)
            if t == "}":
                return end
            if self.typed and t == "type" and self.next(end)[0] == "name" and self.next(end)[1] != "as":
                kind, t, at, end = self.next(end)
            if kind not in ("name", "string") or "." in t and kind == "name":
                raise Invalid(at, "unexpected end of file" if kind == "end" else f"unexpected '{t}'")
            kind, t, at, e = self.next(end)
            if t == "as":
                kind, t, at, end = self.next(e)
                if kind not in ("name", "string"):
                    raise Invalid(at, "a name expected")
                kind, t, at, e = self.next(end)
            if t == ",":
                i = e
            elif t == "}":
                return e
            else:
                raise Invalid(at, "unexpected end of file" if kind == "end" else f"unexpected '{t}'")

    def export_(self, i: int, after: int) -> tuple[int, int, bool]:
        """After 'export': the place to go on, the state there, and whether an expression follows."""
        kind, t, at, end = self.next(after)
        if t == "*":
            kind, t, at, end = self.next(end)
            if t == "as":
                kind, t, at, end = self.next(end)
                kind, t, at, end = self.next(end)
            if t != "from":
                raise Invalid(at, "'from' expected")
            kind, t, at, end = self.next(end)
            if kind != "string":
                raise Invalid(at, "a module expected")
            return end, OPERATOR, False
        if self.typed and t == "type" and self.next(end)[1] in ("{", "*"):
            return self.export_(i, end)
        if t == "{":
            end = self.specifiers(end)
            kind, t, at, e = self.next(end)
            if t == "from":
                kind, t, at, e = self.next(e)
                if kind != "string":
                    raise Invalid(at, "a module expected")
                end = e
            return end, OPERATOR, False
        if t == "default":
            kind, t, at, e = self.next(end)
            if t in ("function", "class") or t == "async" and self.next(e)[1] == "function":
                if t == "class":
                    return at, START, False
                j = self.next(e)[3] if t == "async" else e
                kind, t, a2, e2 = self.next(j)
                if t == "*":
                    kind, t, a2, e2 = self.next(e2)
                return at, (START if kind == "name" else OPERAND), kind != "name"
            if self.typed and t in ("abstract", "interface"):
                return at, START, False
            return end, OPERAND, True
        if self.typed and t == "=":
            return end, OPERAND, True
        if self.typed and t in ("import", "as"):
            return at, START, False
        if t in ("const", "let", "var", "function", "class", "async") or self.typed and t in ("interface", "type", "enum", "namespace", "module", "declare", "abstract") or t == "@":
            return at, START, False
        raise Invalid(at, "unexpected end of file" if kind == "end" else f"unexpected '{t}' after 'export'")

    def typed_declaration(self, what: str, i: int) -> tuple[int, str]:
        """After the name of an interface, type, enum or namespace; what is open afterwards."""
        kind, t, at, end = self.next(i)
        if t == "<" and what in ("interface", "type"):
            kind, t, at, end = self.next(self.type_parameters(at))
        if what == "interface":
            if t == "extends":
                while True:
                    kind, t, at, end = self.next(self.type_reference(end))
                    if t != ",":
                        break
            if t != "{":
                raise Invalid(at, "unexpected end of file" if kind == "end" else "'{' expected")
            return self.type_members(end), ""
        if what == "type":
            if t != "=":
                raise Invalid(at, "unexpected end of file" if kind == "end" else "'=' expected")
            return self.type(end), "alias"
        if t != "{":
            raise Invalid(at, "unexpected end of file" if kind == "end" else "'{' expected")
        return (end, "enum") if what == "enum" else (at, "block")

    def type_reference(self, i: int) -> int:
        kind, t, at, end = self.next(i)
        if kind != "name":
            raise Invalid(at, "a type expected")
        return self.type_arguments(end) if self.text.startswith("<", self.space(end)) else end
