"""Problem 4: source files that do not parse, by lexers and a pushdown stack.

Each language has a lexer for its comments, literals and names; one pass reads a text, pushes and
pops its delimiters (and block keywords where blocks have no braces) and notes conflict markers that
stand outside literals and comments. That finds unterminated literals, unbalanced delimiters and
premature ends. A wrong extension shows in what the pass leaves behind: every kind of token is one
character of a signature, and patterns over the signature find what the grammar of the language
can't hold (two operands side by side, a control word without its head); lines at statement level
are held against shapes of statements, of which each language allows its own.
Python texts that pass are handed to the interpreter's own parser, JSON texts to a strict reader.

The job is one map over the rows; a final distinct over the flagged ids removes redelivered rows.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DQ, _SQ = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'"
_CHAR = r"'(?:[^'\\\n]|\\(?:u\{?[0-9a-fA-F]+\}?|x[0-9a-fA-F]+|[0-7]+|.))'"
_NUM = r"(?:0[xXbBoO][0-9a-fA-F_']+|\d[\d_]*(?:\.(?!\.)[\d_]*)?(?:[eEpP][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)\w*"
# A name goes on with any character beyond ASCII, as combining marks belong to names.
_NAME = r"(?:[^\W\d]|\$)(?:\w|\$|[^\x00-\x7f\s])*"
_CLOSES = {")": "(", "]": "[", "}": "{"}
_OPS = r"===|!==|<<=|>>=|\*\*=|\.\.\.|\.\.=|->|=>|::|:=|\?\?|\?\.|&&|\|\||\+\+|--|<=|>=|==|!=|~=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|//|<<|\*\*|\.\.|[^\s\w]"


def _words(s: str) -> frozenset[str]:
    return frozenset(s.split())


#: Shapes of whole statements, at the start of a line outside brackets and literals. Each language names those it has.
SHAPES = {
    "py_def": r"(?:async\s+)?def\s+\w+\s*\(",
    "py_import": r"from\s+[\w.]+\s+import\b",
    "colon_block": r"(?:if|elif|else|for|while|try|except|finally|with|match)\b(?!<)[^;{}?]*:\s*$",
    "es_import": r"import\s+(?:type\s+)?(?:[\w$]+\s*,?\s*)?(?:\{[^}\n]*\}|\*\s+as\s+[\w$]+)?\s*from\s*[\"']|import\s*\{|import\s*[\"'][^\"'\n]*[\"']\s*;",
    "es_export": r"export\s+(?:default|function|class|const|let|async|interface|type|enum|abstract|declare|\{|\*)",
    "function": r"(?:async\s+)?function\b\s*\*?\s*&?\s*[\w$.:]+\s*\(",
    "lua_local": r"local\s+(?:function\s+)?[A-Za-z_]\w*(?:\s*[,=<(]|\s*$)",
    "end": r"end\b\s*[,;)]*\s*$",
    "gd_func": r"(?:static\s+)?func\s+\w+\s*\([^{}]*:\s*$",
    "extends": r"extends\s+[\w\".]+\s*$",
    "gd_head": r"class_name\s+\w+\s*$|@(?:export|onready)\b|signal\s+\w+\s*(?:\(.*\))?\s*$",
    "gd_var": r"var\s+\w+\s*(?::\s*[\w.]+\s*=\s|:=)",
    "es_var": r"var\s+[\w$]+\s*=\s",
    "go_var": r"var\s+\w+\s+(?:[\w.*\[\]]+\s*$|[\w.*\[\]]+\s*=[^=])|var\s*\(\s*$",
    "go_func": r"func\s+(?:\([^)]*\)\s*)?\w+(?:\[[^\]]*\])?\s*\([^{}:]*\)[^{}:]*\{?\s*$",
    "go_package": r"package\s+\w+\s*$",
    "java_package": r"package\s+[\w.]+\s*;",
    "go_assign": r"[\w.]+(?:\s*,\s*\w+)*\s*:=\s",
    "rs_fn": r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s*\"[^\"]*\")?)\s+)*fn\s+\w+",
    "let": r"let\s+(?:mut\s+)?[\w$({\[]",
    "rs_use": r"(?:pub\s+)?use\s+[\w]+(?:::[\w{}*, :]+)*\s*;|(?:pub\s+)?mod\s+\w+\s*[;{]|impl(?:<[^>]*>)?\s+[\w<>:, ]+\{",
    "php_use": r"use\s+(?:function\s+|const\s+)?\\?\w+(?:\\\w+)*(?:\s+as\s+\w+)?\s*;",
    "include": r"#\s*(?:include|define|ifdef|ifndef|undef)\b",
    "php_open": r"<\?(?:php\b|=)",
    "php_var": r"\$\w+\s*(?:=[^=]|->|\[|\+=|\.=)",
    "cs_using": r"(?:global\s+)?using\s+(?:static\s+)?[\w.]+(?:\s*=\s*[\w.<>]+)?\s*;",
    "java_import": r"import\s+(?:static\s+)?[\w]+(?:\.[\w*]+)+\s*;",
    "go_import": r"import\s+(?:[\w.]+\s+)?\"[^\"\n]*\"\s*$|import\s*\(\s*$",
    "namespace": r"namespace\s+[\w.\\]+\s*[;{]?\s*$",
    "class": r"(?:(?:public|private|protected|internal|abstract|final|static|sealed|partial)\s+)*class\s+\w+(?:[^=\n]*\{|\s*$|\s+(?:extends|implements)\b|\s*:\s*\w)",
    "method": r"(?:public|private|protected|internal)\s+(?:(?:static|final|abstract|override|virtual|async|readonly|const|sealed)\s+)*[\w<>\[\],.?]+\s+\w+\s*(?:\(|=[^=]|;)",
    "typed_function": r"(?:static\s+)?(?:void|int|char|long|float|double|bool|boolean|string|String)\s*\**\s+\**\w+\s*\([^;{}=]*\)\s*\{\s*$",
    "typed_var": r"(?:int|char|long|float|double|bool|boolean|string|String)\s+\**\w+\s*=[^=]",
    "const": r"const\s+[\w$]+\s*=[^=]",
    "head_for": r"for\s*\(\s*(?:let|const|var|int|local|auto|long|char|String|string)\b",
    "head_each": r"foreach\s*\(",
    "while": r"while\s*\(?[\w!]",
    "try": r"try\s*\{",
    "throw_new": r"throw\s+new\b",
    "gd_elif": r"(?:elif|elseif)\b",
    "then": r"if\b.*\bthen\s*$|for\b.*\bdo\s*$",
    "markup": r"<(?:!DOCTYPE|!doctype|\?xml|!--|html\b)",
    "require": r"(?:var|const|let)\s+[\w${}, ]+\s*=\s*require\s*\(",
}


@dataclass
class Language:
    """Lexical rules of one language, its words, and the statement shapes it has."""

    comments: str
    strings: str
    keywords: frozenset[str]
    shapes: frozenset[str]
    adjacent: str = ""  # pattern over the signature of tokens that can't follow each other on a line
    heads: frozenset[str] = frozenset()  # words that a "(" follows
    semicolons: bool = False
    find: re.Pattern = field(init=False)
    foreign: re.Pattern = field(init=False)
    apart: re.Pattern | None = field(init=False)

    def __post_init__(self):
        self.find = re.compile(
            rf"[^\S\n]*(?:(?P<com>{self.comments})|(?P<str>{self.strings})|(?P<bad>/\*|[\"'`])|(?P<name>[@#]?{_NAME})|(?P<num>{_NUM})|(?P<nl>\n\s*|\\\n)|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<op>{_OPS})|(?P<rest>\s+|.))",
            re.S,
        )
        self.foreign = re.compile("|".join(f"(?:{p})" for n, p in SHAPES.items() if n not in self.shapes))
        self.apart = re.compile(self.adjacent) if self.adjacent else None


_C_COM = r"//(?:\\\n|[^\n])*|/\*.*?\*/"
_NAME_ = r"[A-Za-z_]\w*"
# Keywords of the languages, as far as the rules below need them.
_JS_KW = _words("await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new of return static super switch this throw try typeof var void while with yield async get set from as true false null undefined using")
_TS_KW = _JS_KW | _words("abstract any as asserts declare enum implements infer interface is keyof module namespace never number object private protected public readonly string boolean type unknown satisfies override accessor global unique out symbol bigint")
_ES_SHAPES = _words("extends end es_import es_export function es_var let const class head_for while try throw_new require php_var")
LANGUAGES: dict[str, Language] = {
    "js": Language(_C_COM, f"{_DQ}|{_SQ}", _JS_KW, _ES_SHAPES, "[n0s][n0s]|[0s]t", _words("if while for switch with")),
    "ts": Language(_C_COM, f"{_DQ}|{_SQ}", _TS_KW, _ES_SHAPES | _words("namespace method gd_var"), "[n0s][n0s]|[0s]t", _words("if while for switch with")),
    "go": Language(_C_COM, rf"{_DQ}|`[^`]*`|{_CHAR}", _words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false"), _words("go_func go_package go_assign go_import go_var es_var const"), "0[0sn]"),
    "rs": Language(r"//[^\n]*", rf"[bc]?r(?P<rh>#*)\".*?\"(?P=rh)|[bc]?\"(?:[^\"\\]|\\.)*\"|b?{_CHAR}|'{_NAME_}\b(?!')", _words("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while"), _words("rs_fn let rs_use while php_var php_use const end")),
    "java": Language(_C_COM, rf'"""(?:[^"\\]|\\.|"(?!""))*"""|{_DQ}|{_CHAR}', _words("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while var record sealed permits yield non when null true false module requires exports opens provides uses with to"), _words("extends end java_package java_import class method typed_function typed_var es_var head_for while try throw_new"), "[0s][0sn]", _words("if while for switch"), True),
    "c": Language(_C_COM, rf"(?:u8|[uUL])?{_DQ}|[uUL]?'(?:[^'\\\n]|\\.)+'", _words("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while"), _words("end include typed_function typed_var head_for while"), "", _words("if while for switch"), True),
    "cs": Language(_C_COM, r'\$*(?P<q3>"{3,}).*?(?P=q3)|(?:@\$?|\$@)"(?:[^"]|"")*"|\$"(?:[^"\\{\n]|\\.|\{\{|\{[^{}"\n]*(?:"[^"\n]*"[^{}"\n]*)*\})*"|' + _DQ + "|" + _CHAR, _words("abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw try typeof uint ulong unchecked unsafe ushort using var virtual void volatile while async await get set init record where yield partial dynamic when and or not from select group by into orderby join let on equals ascending descending true false with required file scoped global"), _words("end cs_using namespace class method typed_function typed_var es_var head_for head_each while try throw_new py_import let"), "[0s][0sn]", _words("if while for foreach switch lock"), True),
    "php": Language(r"//[^\n]*?(?=\?>|\n|\Z)|#(?!\[)[^\n]*?(?=\?>|\n|\Z)|/\*.*?\*/", r'"(?:[^"\\]|\\.)*"|' + r"'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|<<<[ \t]*(?P<hq>[\"']?)(?P<hd>\w+)(?P=hq)\n(?:.*?\n)??[ \t]*(?P=hd)\b", _words("abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile enum extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield from"), _words("extends markup rs_use function php_use php_open php_var namespace class method const head_for head_each while try throw_new gd_elif colon_block"), "[0s][0sn]", _words("if while for foreach switch elseif"), True),
    "lua": Language(r"--\[(?P<lc>=*)\[.*?\](?P=lc)\]|--(?!\[=*\[)[^\n]*", rf"\"(?:[^\"\\\n]|\\(?:z\s+|.))*\"|'(?:[^'\\\n]|\\(?:z\s+|.))*'|\[(?P<ls>=*)\[.*?\](?P=ls)\]", _words("and break do else elseif end false for function goto if in local nil not or repeat return then true until while"), _words("function lua_local end then while gd_elif"), "[n0][n0]|s[n0s]|0s|\\}n"),
    "gd": Language(r"#[^\n]*", rf'&?"""(?:[^\\]|\\.)*?"""|&?\'\'\'(?:[^\\]|\\.)*?\'\'\'|[&^$%r]?(?:"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\')|[$%](?:{_NAME_}|%)(?:/%?{_NAME_})*', _words("and as assert await break breakpoint class class_name const continue elif else enum export extends for func if in is master match mastersync not null onready or pass preload puppet puppetsync remote remotesync return self set get setget signal static super tool true false var void when while yield namespace trait abstract"), _words("extends gd_func gd_head gd_var es_var const colon_block gd_elif while class let php_var"), "[n0s][n0s]"),
}
EXTENSIONS = {".js": "js", ".mjs": "js", ".ts": "ts", ".tsx": "ts", ".go": "go", ".rs": "rs", ".java": "java", ".c": "c", ".cs": "cs", ".php": "php", ".lua": "lua", ".gd": "gd", ".py": "py", ".json": "json"}
_CONFLICT = re.compile(r"^(?:(?:<{7}|\|{7}|>{7})(?:[ \t][^\n]*)?|={7})$", re.M)


class Broken(Exception):
    """A text isn't of its language; the message says why."""


class Tokens:
    """Tokens without blanks and comments, column by column; ``top`` is the innermost open delimiter."""

    __slots__ = ("kind", "text", "first", "end", "depth", "top", "source")

    def __init__(self, source: str):
        self.source = source
        self.kind: list[str] = []
        self.text: list[str] = []
        self.first: list[bool] = []
        self.end: list[int] = []
        self.depth: list[int] = []
        self.top: list[str] = []

    def __len__(self) -> int:
        return len(self.kind)

    def line(self, k: int) -> int:
        return self.source.count("\n", 0, self.end[k] - len(self.text[k])) + 1


_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_TPL = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_IN_TPL = re.compile(rf"(?:[^{{}}`\"'/]|(?<=[(,=:!&|?;{{\[])/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*|//[^\n]*|/\*.*?\*/|/|{_DQ}|{_SQ})*", re.S)
_DIRECTIVE = re.compile(r"#\s*(\w*)")
_RS_COM = re.compile(r"/\*|\*/")
_PHP_OPEN = re.compile(r"<\?(?:php\b|=)")
#: Tokens after which a slash starts a regular expression.
_BEFORE_REGEX = _words("return typeof case in of delete void throw new do else instanceof yield await }")


def _template_end(text: str, at: int) -> int:
    """Where the template literal that starts at ``at`` ends; -1 if it doesn't. A stack holds templates and braces."""
    stack, pos = ["`"], at + 1
    while True:
        pos = (_TPL if stack[-1] == "`" else _IN_TPL).match(text, pos).end()
        if pos >= len(text):
            return -1
        c = text[pos]
        if stack[-1] == "`":
            pos += 1 if c == "`" else 2
            if c != "`":
                stack.append("{")
            else:
                stack.pop()
        elif c in "\"'":
            return -1
        else:
            pos += 1
            if c == "}":
                stack.pop()
            else:
                stack.append(c)
        if not stack:
            return pos


def _comment_end(text: str, at: int) -> int:
    """Where the nested comment that starts at ``at`` ends; -1 if it doesn't."""
    depth = 0
    for m in _RS_COM.finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if depth == 0:
            return m.end()
    return -1


def lex(lang: str, text: str) -> Tokens:
    """Read ``text`` (line ends are ``\\n``) and push and pop its delimiters; raises ``Broken`` at the first fault."""
    spec, out, pos, first = LANGUAGES[lang], Tokens(text), 0, True
    find, keywords = spec.find.finditer, spec.keywords
    kinds, texts, firsts, ends, depths, tops = out.kind, out.text, out.first, out.end, out.depth, out.top
    marks = {m.start() for m in _CONFLICT.finditer(text)} if "<<<<<<<" in text or "=======" in text or ">>>>>>>" in text or "|||||||" in text else ()
    es, directives = lang in ("js", "ts"), lang in ("c", "cs")
    stack: list[str] = []
    branches: list[tuple[list[str], list[str] | None]] = []
    heads: list[bool] = []
    top, headed = "", False  # whether the last parenthesis closed the head of a control statement
    if lang in ("js", "ts", "rs", "lua", "gd") and text.startswith("#!") and not (lang == "rs" and text.startswith("#![")):
        pos = text.find("\n")
        if pos < 0:
            return out
    if lang == "php":
        m = _PHP_OPEN.search(text)
        pos = m.end() if m else len(text)

    def fault(what: str, at: int) -> Broken:
        return Broken(f"{what} at line {text.count(chr(10), 0, at) + 1}")

    while True:
        again = False
        for m in find(text, pos):
            kind = m.lastgroup
            value = m.group(kind)
            if kind == "nl":
                first = first or value[0] == "\n"
                continue
            if marks and first and m.start(kind) in marks:
                raise fault("conflict marker", m.start(kind))
            if kind == "com":
                continue
            if directives and first and value[0] == "#":
                at = end = m.start(kind)
                while True:  # a directive with its continued lines
                    end = text.find("\n", end)
                    if end < 0:
                        end = len(text)
                        break
                    if text[end - 1] != "\\":
                        break
                    end += 1
                word = _DIRECTIVE.match(text, at).group(1)
                if word.startswith("if"):
                    branches.append((stack[:], None))
                elif word.startswith("el") and branches:  # each branch starts where the first did
                    base, done = branches.pop()
                    branches.append((base, stack if done is None else done))
                    stack = base[:]
                elif word == "endif" and branches:
                    stack = branches.pop()[1] or stack
                top = stack[-1] if stack else ""
                kinds.append("d"), texts.append(text[at:end]), firsts.append(True), ends.append(end), depths.append(len(stack)), tops.append(top)
                first, pos, again = False, end, True
                break
            if kind == "name":
                kind = "k" if value in keywords else "n"
            elif kind == "op":
                if value == "/" or value == "/=":
                    if es and (not kinds or kinds[-1] in "o([{" and texts[-1] not in ("++", "--") or texts[-1] in _BEFORE_REGEX or kinds[-1] == ")" and headed):
                        r = _JS_REGEX.match(text, m.start(kind))
                        if r:
                            kinds.append("s"), texts.append(r.group()), firsts.append(first), ends.append(r.end()), depths.append(len(stack)), tops.append(top)
                            first, pos, again = False, r.end(), True
                            break
                elif value == "?" and lang == "php" and text.startswith(">", m.end()):
                    n = _PHP_OPEN.search(text, m.end())
                    kinds.append("o"), texts.append(";"), firsts.append(first), ends.append(m.end()), depths.append(len(stack)), tops.append(top)
                    first, pos, again = True, n.end() if n else len(text), True
                    break
                kind = "o"
            elif kind == "open":
                kinds.append(value), texts.append(value), firsts.append(first), ends.append(m.end()), depths.append(len(stack)), tops.append(top)
                if es:
                    heads.append(value == "(" and len(texts) > 1 and texts[-2] in spec.heads)
                stack.append(value)
                top, first = value, False
                continue
            elif kind == "close":
                if not stack or stack.pop() != _CLOSES[value]:
                    raise fault(f"unbalanced {value}", m.start(kind))
                top = stack[-1] if stack else ""
                kind = value
                if es:
                    headed = heads.pop()
            elif kind == "str":
                kind = "s"
            elif kind == "num":
                kind = "0"
            elif kind == "bad":
                at = m.start(kind)
                if value == "`" and es:
                    end = _template_end(text, at)
                elif value == "/*" and lang == "rs":
                    end = _comment_end(text, at)
                else:
                    end = -1
                if end < 0:
                    raise fault("unterminated literal", at)
                if value == "`":
                    kinds.append("t"), texts.append(text[at:end]), firsts.append(first), ends.append(end), depths.append(len(stack)), tops.append(top)
                    first = False
                pos, again = end, True
                break
            elif value.isspace() or value == "\ufeff":
                continue
            else:
                kind = "o"
            kinds.append(kind)
            texts.append(value)
            firsts.append(first)
            ends.append(m.end())
            depths.append(len(stack))
            tops.append(top)
            first = False
        if not again:
            break
    if stack:
        raise Broken("premature end: open " + " ".join(stack))
    return out


def _statements(t: Tokens) -> Iterator[tuple[int, str]]:
    """(token, rest of the line) of each line that starts at statement level."""
    for k, first in enumerate(t.first):
        if first and t.top[k] not in ("(", "[") and t.kind[k] not in "s0t":
            at = t.end[k] - len(t.text[k])
            end = t.source.find("\n", at)
            yield k, t.source[at : end if end >= 0 else len(t.source)].rstrip()


def _foreign(lang: str, t: Tokens) -> None:
    match = LANGUAGES[lang].foreign.match
    macros = lang == "rs" and "macro_rules!" in t.source
    for k, said in _statements(t):
        if match(said) and not (t.kind[k] == "d" and lang == "c") and not macros:
            if t.kind[k] == "d" and not re.match(r"#\s*include\b", said):
                continue
            raise Broken(f"a statement of another language at line {t.line(k)}")


def _adjacent(lang: str, t: Tokens) -> None:
    """No two operands side by side on one line, as far as the language never has them so."""
    apart = LANGUAGES[lang].apart
    if apart is None or lang in ("js", "ts") and ("</" in t.source or "/>" in t.source) and _ELEMENT.search(t.source):
        return  # attributes of elements stand side by side
    signature = "".join("\n" + k if f else k for k, f in zip(t.kind, t.first))
    m = apart.search(signature)
    if m:
        raise Broken(f"operands without an operator at line {t.line(m.start() - signature.count(chr(10), 0, m.start() + 1))}")


#: Words after which a text can end.
_LAST = _words("this super self Self true false null nil int get set any string number boolean object return break continue from as of type undefined default bigint symbol unknown never void char long double float short byte async module global unique override abstract declare readonly file required out is in to with uses on by debugger yield")


def _c_family(lang: str, t: Tokens) -> None:
    spec, n = LANGUAGES[lang], len(t)
    if not n:
        return
    last, kind = t.text[-1], t.kind[-1]
    if kind == "o" and last not in (";", "?>", "++", "--", "?", ">", "!", "*", ",") or kind == "k" and last in spec.keywords - _LAST:
        raise Broken("premature end")
    if spec.semicolons and kind not in "d}" and last not in (";", ">", ",") and not (lang == "c" and (kind == ")" or last.isupper())):
        raise Broken("premature end: no semicolon")
    for k in range(n - 1):
        if t.kind[k] == "k" and t.text[k] in spec.heads and t.kind[k + 1] != "(":
            before, after = t.text[k - 1] if k else "", t.text[k + 1]
            if before in (".", "->", "?.", "::", "?->", "#", "@") or after in (":", "=", ",", "}", ";", "?", ")", "await", "<", "when", "!", "]", "constexpr", ".", "?.") or after == "{" and t.text[k] == "switch":
                continue
            raise Broken(f"{t.text[k]} without ( at line {t.line(k)}")
    if lang in ("java", "cs", "js", "ts", "php"):
        pair = re.compile(r"[=&|]")
        for k in range(n - 1):
            if t.kind[k] == "o" and pair.search(t.text[k]) and t.text[k] in ("=", "==", "===", "&&", "||") and (t.kind[k + 1] == ")" or t.text[k + 1] in (";", ",")):
                raise Broken(f"{t.text[k]} {t.text[k + 1]} at line {t.line(k)}")
    _adjacent(lang, t)
    _foreign(lang, t)
    if spec.semicolons:
        _semicolons(t)
    if lang == "js":
        _untyped(t)
    if lang in ("rs", "go", "php", "js"):
        _function_heads(lang, t)


def _untyped(t: Tokens) -> None:
    """Parameters and results of plain scripts have no types."""
    kind, text = t.kind, t.text
    for k in range(2, len(t) - 1):
        if text[k] != ":" or kind[k] != "o" or kind[k + 1] not in "nk":
            continue
        if t.top[k] == "(" and kind[k - 1] == "n" and kind[k - 2] in "(o" and text[k - 2] in ("(", ",") and k + 2 < len(t) and (kind[k + 2] == ")" or text[k + 2] in (",", "=")):
            raise Broken(f"a type in a parameter list at line {t.line(k)}")
        if kind[k - 1] == ")" and k + 2 < len(t) and kind[k + 2] == "{" and not any(x in ("?", "case", "default") for x in text[max(0, k - 200) : k]):
            raise Broken(f"a result type at line {t.line(k)}")


def _function_heads(lang: str, t: Tokens) -> None:
    """Between a function's name and its body stands nothing that starts a statement."""
    word = {"rs": "fn", "go": "func", "php": "function", "js": "function"}[lang]
    stop = {word, "let", "return", "while", "pub", "use", "mod", "var"} if lang != "go" else {"func", "return", "var", "type", "const", "import"}
    for k in range(len(t) - 1):
        if t.text[k] != word or t.kind[k] != "k" or t.kind[k + 1] != "n" or t.top[k] in ("(", "["):
            continue
        depth, seen = t.depth[k], False
        for j in range(k + 2, len(t)):
            if t.depth[j] == depth and t.kind[j] == "(":
                seen = True
            if t.depth[j] <= depth and (t.kind[j] in "{}" or t.text[j] in (";", "=>")):
                break
            if t.depth[j] == depth and t.first[j] and t.text[j] in stop and t.kind[j] == "k":
                if lang == "go" and seen:
                    break  # a declaration without a body
                raise Broken(f"a head without a body at line {t.line(k)}")
        else:
            if lang != "go" or not seen:
                raise Broken(f"a head without a body at line {t.line(k)}")
            if t.source.rstrip().count("\n") + 1 == t.line(k):
                raise Broken("premature end: a head without a body")
        if not seen and t.kind[k + 2] != "o" and lang != "php":
            raise Broken(f"a head without parameters at line {t.line(k)}")


_STARTS = _words("return if for while switch do break continue throw goto try foreach")


def _semicolons(t: Tokens) -> None:
    """A return or an assignment that ends in an operand isn't followed by another statement or the block's end."""
    kind, text, depth = t.kind, t.text, t.depth
    for k in range(1, len(t)):
        block_end = kind[k] == "}"
        if not (block_end or t.first[k] and kind[k] == "k" and text[k] in _STARTS) or kind[k - 1] not in "n0s)]":
            continue
        level, j, assigned = depth[k] + block_end, k - 1, False
        while j >= 0 and not (depth[j] <= level and (kind[j] in "{}d" or text[j] in (";", ":")) and (depth[j] == level or kind[j] == "{")):
            assigned |= depth[j] == level and text[j] == "="
            j -= 1
        if t.top[k - 1] != "{" and kind[k - 1] not in ")]" or j + 1 >= k:
            continue
        if text[j + 1] == "return" or assigned and not block_end:
            raise Broken(f"no semicolon at line {t.line(k - 1)}")


def _lua(t: Tokens) -> None:
    stack: list[str] = []
    kind, text = t.kind, t.text
    for k, w in enumerate(text):
        if kind[k] != "k":
            continue
        if w in ("function", "repeat", "if", "while", "for"):
            stack.append(w)
        elif w == "do":
            if stack and stack[-1] in ("while", "for"):
                stack[-1] = "do"
            else:
                stack.append("do")
        elif w == "then":
            if not stack or stack[-1] not in ("if", "elseif"):
                raise Broken(f"then without if at line {t.line(k)}")
            stack[-1] = "then"
        elif w in ("elseif", "else"):
            if not stack or stack[-1] != "then":
                raise Broken(f"{w} without then at line {t.line(k)}")
            stack[-1] = "elseif" if w == "elseif" else "else"
        elif w == "end":
            if not stack or stack[-1] in ("repeat", "if", "while", "for", "elseif"):
                raise Broken(f"end without a block at line {t.line(k)}")
            stack.pop()
        elif w == "until":
            if not stack or stack.pop() != "repeat":
                raise Broken(f"until without repeat at line {t.line(k)}")
        if w == "function" and k + 1 < len(t) and kind[k + 1] == "n":
            j = k + 1
            while j < len(t) and (kind[j] == "n" or text[j] in (".", ":")):
                j += 1
            if j >= len(t) or kind[j] != "(":
                raise Broken(f"function without ( at line {t.line(k)}")
        if w in ("local", "return") and k + 1 < len(t) and (kind[k + 1] == ")" or text[k + 1] in ("=", ",")):
            raise Broken(f"{w} {text[k + 1]} at line {t.line(k)}")
    if stack:
        raise Broken("premature end: open " + " ".join(stack))
    _adjacent("lua", t)
    if t.kind and (kind[-1] == "o" and text[-1] not in (";", "...", "::") or kind[-1] == "k" and text[-1] in ("local", "not", "and", "or", "in")):
        raise Broken("premature end")
    never = _words("! && || ++ += -= => ? @ $ ` := ?? ?. !== ===")
    for k, w in enumerate(text):
        if kind[k] == "o" and w in never:
            raise Broken(f"{w} at line {t.line(k)}")
    _foreign("lua", t)


_COLON_HEADS = _words("func if elif else for while match class static")


def _gd(t: Tokens) -> None:
    kind, text, source = t.kind, t.text, t.source
    starts: list[int] = []
    for k, first in enumerate(t.first):
        if first and not (starts and (t.depth[k] > 0 or kind[k] in ")]}")) and not (starts and source[: t.end[k] - len(text[k])].rstrip(" \t").endswith("\\\n")):
            starts.append(k)
    foreign = LANGUAGES["gd"].foreign.match
    indents, expect = [0], None
    for a, b in zip(starts, [*starts[1:], len(t)]):
        at = t.end[a] - len(text[a])
        start = source.rfind("\n", 0, at) + 1
        lead = source[start:at].lstrip("\ufeff")
        width = len(lead.expandtabs(4)) if not lead.strip(" \t") else 0
        if expect is not None:
            if width <= indents[-1]:
                raise Broken(f"no body after the head at line {t.line(expect)}")
            indents.append(width)
        else:
            while indents and width < indents[-1]:
                indents.pop()
            if not indents or width != indents[-1]:
                raise Broken(f"indentation at line {t.line(a)}")
        expect = None
        end = source.find("\n", at)
        if foreign(source[at : end if end >= 0 else len(source)].rstrip()):
            raise Broken(f"a statement of another language at line {t.line(a)}")
        head, nxt = text[a], text[a + 1] if a + 1 < b else ""
        block = head in _COLON_HEADS and kind[a] == "k" and (head != "static" or nxt == "func") and nxt not in (".", "=")
        if block and ":" not in [text[k] for k in range(a, b) if t.depth[k] == t.depth[a]]:
            raise Broken(f"no colon at line {t.line(a)}")
        last = b - 1
        if text[last] == ":" and t.depth[last] == t.depth[a]:
            expect = a
        elif kind[last] == "o" and text[last] not in ("?", "*", ";"):
            raise Broken(f"premature end of line {t.line(last)}")
        if head == "func" and a + 1 < b and kind[a + 1] == "n" and (a + 2 >= b or kind[a + 2] != "("):
            raise Broken(f"func without ( at line {t.line(a)}")
        signature = "".join("a" if kind[k] == "n" and text[k][0] == "@" else kind[k] for k in range(a, b))
        m = LANGUAGES["gd"].apart.search(signature)
        if m:
            raise Broken(f"operands without an operator at line {t.line(a + m.start())}")
        for k in range(a, b):
            if kind[k] == "o" and text[k] in ("++", "=>", "?", "===", "!=="):
                raise Broken(f"{text[k]} at line {t.line(k)}")
    if expect is not None:
        raise Broken("premature end: no body")


#: Text between the tags of elements in a script, in which quotes are no quotes; what holds brackets or operators is code.
_ELEMENT_TEXT = re.compile(r"(?<=[\w\"'}/]>)([^<>{}()=;]*[^<>{}()=;\s][^<>{}()=;]*)(?=<[/A-Za-z]|\{)")


#: An element where a value can stand.
_ELEMENT = re.compile(r"(?:\breturn|[=(?:,&|>\[])\s*<(?:[A-Za-z][\w.]*(?:\s[^<>]*)?/?)?>")


def _never(x):
    raise Broken(f"{x} is no JSON value")


_JSON_LEX = re.compile(r'(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(?P<val>-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][-+]?[0-9]++)?|true|false|null)|(?P<mark>[\[\]{},:])|[ \t\n\r]++')


def _deep_json(text: str) -> None:
    """The grammar of JSON with a stack of its own, for values nested deeper than the parser goes."""
    pos, open_, want = 0, [], "value"  # want: value, first (value or ]), key, first key (key or }), colon, next
    while pos < len(text):
        m = _JSON_LEX.match(text, pos)
        if m is None:
            raise Broken("no token of JSON")
        pos, kind, t = m.end(), m.lastgroup, m.group()
        if kind is None:
            continue
        if want in ("value", "first") and (kind in ("str", "val") or t in "[{"):
            if kind == "mark":
                open_.append(t)
                want = "first" if t == "[" else "first key"
            else:
                want = "next"
        elif want in ("key", "first key") and kind == "str":
            want = "colon"
        elif want == "colon" and t == ":":
            want = "value"
        elif want == "next" and t == "," and open_:
            want = "value" if open_[-1] == "[" else "key"
        elif open_ and (t == "]" and open_[-1] == "[" and want in ("first", "next") or t == "}" and open_[-1] == "{" and want in ("first key", "next")):
            open_.pop()
            want = "next"
        else:
            raise Broken("misplaced token of JSON")
    if want != "next" or open_:
        raise Broken("JSON ends early")


def check(lang: str, text: str) -> str | None:
    """Why ``text`` isn't valid in ``lang``, or None."""
    try:
        if lang == "json":
            try:
                json.loads(text, parse_constant=_never, parse_int=str)
            except RecursionError:
                _deep_json(text)
            return None
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        if lang == "py":
            return _python(text)
        if lang == "php" and not _PHP_OPEN.search(text):
            return "no code of the language" if text.strip() and not re.match(r"\s*<[!a-zA-Z?]", text) else None
        if lang in ("js", "ts") and "</" in text and _ELEMENT.search(text):
            text = _ELEMENT_TEXT.sub(lambda m: re.sub("[\"'`]", " ", m.group()), text)
        tokens = lex(lang, text)
        if lang == "lua":
            _lua(tokens)
        elif lang == "gd":
            _gd(tokens)
        else:
            _c_family(lang, tokens)
    except Broken as e:
        return str(e)
    except (RecursionError, MemoryError):
        return None  # a limit of this judge, not of the text
    except ValueError as e:
        return f"{type(e).__name__}: {str(e)[:80]}"
    return None


_PY_LEX = re.compile(
    r"(?P<com>#[^\n]*)|(?P<str>(?i:[rbfu]{0,2})(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|" + _DQ + "|" + _SQ + r"))|(?P<bad>[\"'])|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<rest>[^\"'#()\[\]{}]+)",
    re.S,
)


def _python(text: str) -> str | None:
    """Lexer and stack first; what passes is parsed."""
    nested = "'" in text and re.search(r"(?i)\b[rb]?f[rb]?['\"]", text)
    if not nested:  # quotes within the fields of an f-string are left to the parser
        stack: list[str] = []
        for m in _PY_LEX.finditer(text):
            if m.lastgroup == "bad":
                raise Broken("unterminated literal")
            if m.lastgroup == "open":
                stack.append(m.group())
            elif m.lastgroup == "close":
                if not stack or stack.pop() != _CLOSES[m.group()]:
                    raise Broken(f"unbalanced {m.group()} at line {text.count(chr(10), 0, m.start()) + 1}")
            elif m.lastgroup == "rest" and "\n" in m.group() and _CONFLICT.search(m.group(), m.group().index("\n") + 1):
                raise Broken("conflict marker")
        if stack:
            raise Broken("premature end: open " + " ".join(stack))
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text.lstrip("﻿"))
    except (RecursionError, MemoryError):
        return None  # nested deeper than the parser goes; lexer and stack found nothing
    except SyntaxError as e:
        if "too many nested parentheses" in e.msg or "too many levels of indentation" in e.msg:
            return None
        return f"SyntaxError: {e.msg}"
    return None


def broken_sources(df: DataFrame, id_col: str, text_col: str, ext_col: str) -> DataFrame:
    """(id, lang, reason, broken) of every text of a known extension, once for each id.

    Null texts are not judged (no row); empty and blank texts are valid but for JSON, where no value
    is no value. Unknown and null extensions give no rows. Texts of any length are read whole.
    Redelivered rows count once. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                lang = EXTENSIONS.get(e.lower())
                if lang is not None:
                    why = check(lang, t)
                    rows.append((i, lang, why, why is not None))
            cols = list(zip(*rows)) or [()] * 4
            types = (pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "lang", "reason", "broken"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(ext_col).alias("ext"))
    return src.where("text is not null and ext is not null").mapInArrow(run, "id long, lang string, reason string, broken boolean").distinct()


def broken_rates(df: DataFrame, id_col: str, text_col: str, ext_col: str, repo_col: str) -> DataFrame:
    """(repo, lang, n_files, n_broken, rate) over the judged files of each repository and language."""
    judged = broken_sources(df, id_col, text_col, ext_col)
    repos = df.select(F.col(id_col).cast("long").alias("id"), F.col(repo_col).alias("repo")).distinct()
    out = judged.join(repos, "id").groupBy("repo", "lang").agg(F.count("*").alias("n_files"), F.count_if("broken").alias("n_broken"))
    return out.withColumn("rate", F.round(F.col("n_broken") / F.col("n_files"), 6))
