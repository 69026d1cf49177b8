"""The regular expression that cuts Swift source text into structural elements.

One element is a structural token (brace, bracket, comma, conditional-compilation directive, or
the head of a declaration with its attributes and modifiers) together with the blanks and
comments before it and the run of plain tokens after it. Plain tokens, and whole groups of
parentheses or brackets without braces, carry no structure, so they ride along instead of
becoming rows. The expression is total: the matches
of a text join back to that text.

Group loops are possessive throughout, which keeps the Java matcher iterative on long
comments and literals.

Literals, comments and generic clauses nest to a fixed depth here. What goes beyond is not cut wrongly but not matched: its first
character begins an element, which no regular text has (``SUSPECT``), and ``nesting`` rewrites the text.
"""

from functools import partial

# --- blanks, comments, literals ---------------------------------------------------------

# Classes of single Latin characters and \w are table lookups in Java; wider ones come second.
_RARE_SPACE = r"[\u0085\u2028\u2029\uFEFF\p{Z}]"
SPACE = rf"(?:[ \t\n\r\f\x0B]|{_RARE_SPACE})"


def _block_comment(depth: int) -> str:
    """Block comments nest; an unclosed one runs to the end of the text."""
    if depth == 0:
        return r"/\*(?:[^*/]++|\*(?!/)|/(?!\*))*+(?:\*/|\z)"
    return rf"/\*(?:[^*/]++|\*(?!/)|/(?!\*)|{_block_comment(depth - 1)})*+(?:\*/|\z)"


COMMENT = rf"(?://[^\n\r]*+|{_block_comment(4)})"
TRIVIA = rf"(?:[ \t\n\r\f\x0B]++|{COMMENT}|{_RARE_SPACE})"
BREAK = rf"{TRIVIA}*+"


def _interpolation(depth: int) -> str:
    """Content of a ``\\( )`` group inside a one-line literal."""
    plain = r'[^()"\n\r]++'
    if depth == 0:
        return rf'(?:{plain}|"(?:[^"\\\n\r]++|\\[^(\n\r])*+")*+'
    inner = _interpolation(depth - 1)
    return rf'(?:{plain}|"(?:[^"\\\n\r]++|\\\({inner}\)|\\[^(\n\r])*+"|\({inner}\))*+'


def _raw_literals() -> str:
    """Raw literals without interpolation."""
    forms = []
    for hashes in ("###", "##", "#"):
        escape = rf"\\(?!{hashes}\()"
        forms.append(rf'{hashes}"""(?:[^"\\]++|{escape}|"(?!""{hashes}))*+"""{hashes}')
        forms.append(rf'{hashes}"(?!"")(?:[^"\\\n\r]++|{escape}|"(?!{hashes}))*+"{hashes}')
    return "|".join(forms)


# In a literal of several lines, an interpolation without literals of its own.
_CALL = r'\\\((?:[^()"]++|\([^()"]*+\))*+\)'
LITERAL = (
    rf'(?:{_raw_literals()}|"""(?:[^"\\]++|\\[^(]|{_CALL}|"(?!""))*+"""'
    rf'|"(?!"")(?:[^"\\\n\r]++|\\\({_interpolation(2)}\)|\\[^(\n\r])*+")'
)

# --- words ------------------------------------------------------------------------------

_WIDE_CHAR = r"[^\x00-\x7F\u0085\u2028\u2029\uFEFF\p{Z}]"
_WORD_TAIL = rf"(?:\w++|[$]|{_WIDE_CHAR})*+"
IDENTIFIER = rf"(?:(?!\d)\w++{_WORD_TAIL}|`[^`\n]++`|(?:[$]|{_WIDE_CHAR}){_WORD_TAIL})"
OPERATOR_CHAR = r"[-+*/<>=!&|^~?%]"

# Declaration modifiers of the language.
MODIFIERS = (
    "open public package internal fileprivate private final static override required convenience lazy weak "
    "unowned mutating nonmutating dynamic optional indirect prefix postfix infix nonisolated isolated "
    "distributed consuming borrowing"
).split()

# Words that introduce a declaration, by what has to follow them.
NAMED = "func var let class struct enum protocol extension typealias associatedtype actor import".split()
UNNAMED = "init subscript deinit".split()
OTHER_NAMED = "operator precedencegroup macro".split()
_RESERVED = MODIFIERS + NAMED + UNNAMED + OTHER_NAMED

_END = rf"(?!\w|[$]|{_WIDE_CHAR})"


def _any(words) -> str:
    """One of ``words``, grouped by first letter so that most texts fail after one comparison."""
    by_letter: dict[str, list[str]] = {}
    for word in words:
        by_letter.setdefault(word[0], []).append(word[1:])
    options = [f"{letter}(?:{'|'.join(rest)})" for letter, rest in sorted(by_letter.items())]
    return f"(?=[{''.join(sorted(by_letter))}])(?:{'|'.join(options)}){_END}"


def _group(depth: int) -> str:
    """Content of balanced parentheses, literals respected."""
    if depth == 0:
        return rf"(?:[^()\"]++|{LITERAL})*+"
    return rf"(?:[^()\"]++|{LITERAL}|\({_group(depth - 1)}\))*+"


ATTRIBUTE = rf"@{IDENTIFIER}(?:\.{IDENTIFIER})*+(?:\({_group(2)}\))?+"

# `class` is a modifier in `class func` and the like.
_CLASS_MODIFIER = (
    rf"class(?=(?:{TRIVIA}++{_any(MODIFIERS)})*+{TRIVIA}++(?:func|var|let|subscript){_END})"
)
MODIFIER = rf"(?:{_any(MODIFIERS)}(?:\({SPACE}*+\w++{SPACE}*+\))?+|{_CLASS_MODIFIER}|{ATTRIBUTE})"

_PATTERN = rf"(?:{IDENTIFIER}|\({_group(1)}\))"
_MODIFIERS = rf"(?:{MODIFIER}{BREAK})*+"
_ROUTINE = (
    rf"(?:(func){_END}{TRIVIA}++({IDENTIFIER}|(?:(?!/[/*]){OPERATOR_CHAR}|\.)++)"
    # The parameter list may be an element of its own, so a cut-out head ends here.
    rf"|(init){_END}(?={BREAK}[?!]?+{BREAK}(?:[(<]|\z))"
    rf"|(subscript){_END}(?={BREAK}(?:[(<]|\z))"
    rf"|(deinit){_END})"
)
_PROPERTY = rf"(var|let){_END}{BREAK}({_PATTERN})"
_CONTAINER = (
    rf"(?:(class|struct|enum|protocol|extension|typealias|associatedtype|import){_END}{TRIVIA}++({IDENTIFIER})"
    # These words are names elsewhere, as in `= actor` with a declaration on the next line.
    rf"|(actor|macro|precedencegroup){_END}(?!{TRIVIA}++{_any(_RESERVED)}){TRIVIA}++({IDENTIFIER})"
    rf"|(operator){_END}{TRIVIA}++((?:(?!/[/*]){OPERATOR_CHAR}|\.)++))"
)
DECLARATION = rf"{_MODIFIERS}(?:{_ROUTINE}|{_PROPERTY}|{_CONTAINER})"

# Rewrites the head of a declaration to keyword, name, and '=' if one follows.
SEPARATOR = "\x01"
DECLARATION_PARTS = rf"^{DECLARATION}[^=]*+(=?+)[\s\S]*+$"
DECLARATION_REWRITE = f"$1$3$4$5$6$8$10$12{SEPARATOR}$2$7$9$11$13{SEPARATOR}$14"
KEYWORDS = (
    "func var let class struct enum protocol extension typealias associatedtype actor import macro precedencegroup "
    "operator init subscript deinit"
).split()

# --- plain tokens -----------------------------------------------------------------------

DIRECTIVES = "if elseif else endif warning error sourceLocation".split()


def _generic(depth: int) -> str:
    """Content of a generic clause; no braces, literals, ``=`` or unbalanced brackets."""
    plain = r"[\w\s.,?!:&@`~]++|->|\[[^\[\]{}()\"=;]*+\]|\([^(){}\"=;]*+\)"
    return rf"(?:{plain})*+" if depth == 0 else rf"(?:{plain}|<{_generic(depth - 1)}>)*+"


def _open_groups(opener: str, closer: str, plain: str, depth: int) -> str:
    """``depth`` groups that are open at once. Before the next one opens, whole groups may stand that
    are too shallow to be it."""
    skipped = f"{plain}*+"
    found = opener
    for _ in range(depth - 1):
        found = f"{opener}{skipped}{found}"
        skipped = f"(?:{plain}|{opener}{skipped}{closer})*+"
    return found


GENERIC_DEPTH = 3
_DEEP_GENERIC = rf"(?<=[\w`])(?={_open_groups('<', '>', '(?:[^-<>{};=]|->?+)', GENERIC_DEPTH + 2)})"

# Words after which an expression begins.
_BEFORE_EXPRESSION = "return in case where if guard while switch else try throw await yield is as".split()
# A slash that begins an expression and has its fellow on the line is a regular expression of the language.
REGEX_OPENER = (
    r"/(?=[^\s/*][^\n\r]*(?<![ \t])/)"
    rf"(?<=(?:^|[=(,:\[{{;!&|?+*<>~^%\n\r-]|(?<!\w)(?:{'|'.join(_BEFORE_EXPRESSION)})(?=[ \t]))[ \t]{{0,9}}/)"
)
_EXTENDED_REGEX = r"#++/(?=[^\n\r]*/#|[ \t]*[\n\r])"
# What else may stand in a group: no mark that begins something of its own.
_GROUP_MARK = rf'(?:#(?![#"/])|(?!/[/*]|{REGEX_OPENER})/)'


def _flat(depth: int) -> str:
    """A group of parentheses or brackets without braces."""
    inner = "" if depth == 0 else f"|{_flat(depth - 1)}"
    return rf'[(\[](?:[^()\[\]{{}}"/#]++|{LITERAL}|{COMMENT}|{_GROUP_MARK}{inner})*+[)\]]'


def _nest(opener: str, depth: int) -> str:
    """A balanced group of any brackets that declares no class or struct."""
    inner = "" if depth == 0 else "|" + _nest(r"[({\[]", depth - 1)
    # Runs stop at c and s only, to look for the two words.
    letter = rf"(?!(?<!\w)(?:class|struct){_END}{TRIVIA}++[\w`])[cs]"
    return rf'{opener}(?:[^()\[\]{{}}"/#cs]++|{letter}|{LITERAL}|{COMMENT}|{_GROUP_MARK}{inner})*+[)}}\]]'


def _plain(group: str) -> str:
    return (
        rf"(?:{LITERAL}"
        rf"|{group}"
        rf"|(?<=[\w`])<{_generic(GENERIC_DEPTH)}>"
        rf"|\.(?:\.++|{SPACE}*+{IDENTIFIER})?+"
        rf"|(?!{_any(_RESERVED)}){IDENTIFIER}"
        rf"|\d{_WORD_TAIL}"
        rf"|(?!{REGEX_OPENER}|{_DEEP_GENERIC})(?:(?!/[/*]){OPERATOR_CHAR})++"
        rf"|#(?!{_any(DIRECTIVES)}|[#\"/]){IDENTIFIER}"
        r"|[:;\\])"
    )


# What an element begins with only where something nests beyond the expressions above: a literal, comment, generic
# clause or regular expression that was not matched, and attributes and patterns that were cut.
_PARENS = partial(_open_groups, r"\(", r"\)", "[^()]")
SUSPECT = (
    rf"^{TRIVIA}*+(?:[\"</]|#(?!{_any(DIRECTIVES)}|{IDENTIFIER})|@[\w.]++{BREAK}{_PARENS(4)}|(?:var|let){BREAK}{_PARENS(3)})"
)


# An opening brace takes the accessor keyword that follows it.
_ACCESSOR_WORDS = "get set willSet didSet _read _modify".split()
_ACCESSOR = (
    rf"{BREAK}(?:(?:@{IDENTIFIER}(?:\([^()]*+\))?+|(?:mutating|nonmutating){_END}){BREAK})*+{_any(_ACCESSOR_WORDS)}"
)

_OPEN = rf"\{{(?:{_ACCESSOR})?+"


def _rest(plain: str) -> str:
    return rf"#{_any(DIRECTIVES)}|{plain}|[()\[\]]|@?{IDENTIFIER}|[\s\S]"


def _element() -> str:
    plain = _plain(_flat(2))
    structural = rf"(?:[}},]|{_OPEN}|(?=[a-z@]){DECLARATION}|{_rest(plain)})"
    return rf"\G{BREAK}(?:{structural}(?:{BREAK}{plain})*+|\z)"


def _outline() -> str:
    """Elements with whole bodies in them. A braced group that is no type body, no accessor block and
    holds no type is plain as well: after the head of a function, initializer or subscript, and
    after any brace. It is never plain after a type or property, whose braces count."""
    depth = 5
    plain = _plain(_nest(r"[(\[]", depth))
    body = rf"(?:{plain}|(?!\{{{_ACCESSOR}){_nest(chr(92) + '{', depth)})"
    any_body = rf"(?:{plain}|{_nest(chr(92) + '{', depth)})"
    declaration = (
        rf"(?=[a-z@]){_MODIFIERS}(?:{_ROUTINE}(?:{BREAK}{any_body})*+|(?:{_PROPERTY}|{_CONTAINER})(?:{BREAK}{plain})*+)"
    )
    others = rf"(?:,|{_rest(plain)})(?:{BREAK}{plain})*+"
    return rf"\G{BREAK}(?:(?:\}}|{_OPEN})(?:{BREAK}{body})*+|{declaration}|{others}|\z)"


ELEMENT = _element()
OUTLINE = _outline()
ACCESSOR_BRACE = rf"^\{{{_ACCESSOR}"
LEADING = rf"^{TRIVIA}++"
