"""Whether a documentation says anything that name and signature don't.

A grammar cuts the text into clauses, tags, fences and code; the parts that carry no statement
are dropped, and of the others the words are weighed against those of name and signature and
against the words that any documentation might have.
"""

from __future__ import annotations

import re
from functools import lru_cache

from strataloom.llm.peg import Peg

# Words that say what any function is or that templates are made of, by language.
_GENERAL = {
    "en": """a an the this that these those it its is are was were be been being do does did done has have had of to in on at for from by with and or as if then else so
        not no any some all each every only just also will would can could should may might must when where which what who how here there into onto out up down over under between
        function functions method methods procedure routine constructor destructor getter getters setter setters accessor callback handler helper helpers util utils utility utilities wrapper stub
        main test tests testing default defaults public private protected internal external static abstract virtual override overridden implementation implements implement interface
        class object instance module member property field variable arg args argument arguments param params parameter parameters kwarg kwargs input inputs output outputs option options
        return returns returned returning result results value values void none null nil undefined true false type types string str number int integer float bool boolean list dict map array any
        stuff thing things something anything work works job logic simple simply basic base generic general common misc miscellaneous perform performs performing performed
        documentation docs doc docstring description summary comment comments note notes example examples usage purpose raises raise throws throw yields yield see use uses used using called call calls code impl get set new""",
    "de": """der die das den dem des ein eine einer eines einem einen und oder ist sind wird werden von zu im in am an auf mit für bei aus als nach diese dieser dieses
        funktion funktionen methode methoden hilfsfunktion hilfsmethode konstruktor standardkonstruktor destruktor interne internes interner intern öffentliche private getter setter rückgabe rückgabewert ergebnis wert werte parameter
        gibt zurück liefert beschreibung dokumentation test hauptfunktion hauptmethode allgemeine einfache""",
    "fr": """le la les un une des du de d l et ou est sont par pour dans sur avec ce cette ces à au aux en qui que
        fonction fonctions méthode méthodes utilitaire constructeur destructeur défaut interne publique privée accesseur mutateur retour retourne renvoie résultat valeur valeurs paramètre paramètres
        description documentation test principale simple auxiliaire""",
    "es": """el la los las un una unos unas de del y o es son por para en con este esta estos estas al que se
        función funciones método métodos auxiliar constructor destructor defecto interno interna público privado utilidad devuelve retorna resultado valor valores parámetro parámetros
        descripción documentación prueba principal simple ayuda""",
}
GENERAL = frozenset(w for words in _GENERAL.values() for w in words.split())

# How lines begin that are notes to tools, licences, unwritten text or pointers.
_TOOL = r"(?:@ts-|eslint|tslint|jshint|jslint|prettier-|biome-|pylint|flake8|mypy|pyright|ruff|isort|fmt:|yapf|black:|type:\s*ignore|noqa|nosec|pragma|istanbul|c8 |v8 |nolint|go:|\+build|cgo |export \w+$|rustfmt|clippy|allow\(|cfg\(|cspell|codespell|spell-?check|nosonar|sonar|coverage:|region\b|endregion\b|lint:|stylelint|checkstyle|noinspection|webpack|@__|#__|sourcemapping|-\*-|vim?:|vim:)"
_TAG_ONLY = r"@(?:deprecated|internal|override|inheritdoc|private|public|protected|readonly|static|virtual|sealed|beta|alpha|experimental|final|hidden|ignore|async|abstract|api|packageDocumentation|test|nullable|nonnull)\b"
_LICENCE = r"(?:copyright\b|\(c\)|©|spdx-|licen[cs]ed\b|all rights reserved|use of this source|permission is hereby|released under|distributed under|redistribution and use|this (?:file|program|software|code) is (?:part|free|licen[cs]ed|distributed|provided)|part of the (?:distribution|\w+ project)|the software is provided|no warranty|urheberrecht|tous droits|derechos reservados|alle rechte)"
_UNWRITTEN = r"(?:\[?\W{0,2}(?:todo|fixme|xxx|tbd|tba|wip|hack)\b|to be (?:documented|written|done|defined|added|completed|described|filled)|(?:documentation|docs?|docstring|description|comment|text|summary)\b[^.]{0,60}\b(?:goes? here|pending|missing|to follow|later|here|needed|required|tbd|coming soon)|(?:no|missing|insert|add|write|needs?|lacks?|without|undocumented|fill in|put)\b[^.]{0,30}\b(?:documentation|docs?|docstring|description|comments?|summary)\b|undocumented\b|dokumentation (?:fehlt|folgt)|noch (?:zu dokumentieren|nicht dokumentiert)|beschreibung (?:fehlt|folgt)|kommt noch|muss noch|por documentar|sin documentar|sin descripci[oó]n|pendiente|falta (?:la )?(?:documentaci|descripci)|à (?:compléter|documenter|faire|remplir)|documentation manquante|pas de (?:documentation|description)|auto-?generated (?:method|function|constructor|catch|class)? ?stub|generated (?:method|function) stub|待|未记录|未完成|暂无|無し|未定|記述なし|説明なし|後で|lorem ipsum|placeholder|template text|n/?a$|none$|null$|xxx+|unknown$|empty$|\?+$|\.+$|-+$)"
_POINTER = r"(?:@?(?:see|link|inheritdoc|copydoc)\b|\{@(?:link|see|inheritdoc)|siehe\b|vgl\b|wie oben|s\. o|voir\b|cf\b|idem\b|véase\b|veáse\b|ver\b|igual que|same as\b|as above\b|as before\b|ditto\b|refer to\b|inherit(?:s|ed)?\b|implements? (?:the )?(?:interface|base|super|parent|abstract)|overrides? (?:the )?(?:base|super|parent|method|interface)|delegates? to (?:super|base|parent)|geerbt|hérité|heredado|参照|参见|见上|同上|継承|上記)"
_TOOL_AT, _TAG_AT, _LICENCE_AT, _UNWRITTEN_AT, _POINTER_AT = (re.compile(x, re.I) for x in (_TOOL, _TAG_ONLY, _LICENCE, _UNWRITTEN, _POINTER))
#: A pointer with more to say, as in "See x for the limits; the rest ...", is cut at the comma.
_CODE_LINE = re.compile(
    r"^(?:(?:return|assert|print|console\.\w+|let|var|const|if|for|while|else|elif|try|except|catch|throw|raise|yield|await|import|from|del|pass|break|continue|fn|func|def|class|switch|case|use|pub|static|delete|new)\b(?=.*[(){}\[\]=;:]).*[)}\];:{,]$"
    r"|[\w.$\[\]]+\s*(?:[-+*/|&^%]|:)?=\s*[^=].*;?$|[\w.$:]+!?\([^()]*(?:\([^()]*\)[^()]*)*\)[;,]?$|[\w.$]+(?:\+\+|--);$|[{}()\[\];,]+$|return;?$|break;?$|pass$|else\s*\{?$|\}\s*(?:else|catch).*$|>>>.*|\.\.\. .*|#\[.*\]|@\w+\(.*\)$|</?\w+[^>]*>$|return\s+[\w.$(),\s]+;?$|assert\b[^.]*(?:is|==|!=|in)\b.*)",
)
_MARKS = re.compile(r"^[ \t]*(?:/\*[*!]*|\*+/|//[/!]*|\*(?!\w)|#(?!!)+(?!\w)|--(?=\s)|;+(?=\s)|\"{3}|'{3}|<!--|-->)+[ \t]?|[ \t]*(?:\*+/|\"{3}|'{3})[ \t]*$")
_TAGS = re.compile(r"@(?:param|arg|argument|returns?|throws|raises|exception|type|typedef|template|prop|property|yields?|since|version|author|example)\b[ \t]*(?:\{[^}\n]*\})?|:(?:param|parameter|arg|returns?|rtype|type|raises?|ivar|var|yields?)\b([^:\n]*):|(?<![\w`])(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Throws|Example|Examples|Attributes|Notes?|Parameter|Rückgabe|Paramètres|Retour|Parámetros|Devuelve):", re.I)
#: Names that an entry about a parameter begins with; they are words of the signature.
_LABEL = re.compile(r"(?:@(?:param|arg|argument|prop|property)[ \t]+(?:\{[^}\n]*\}[ \t]*)?\[?|:(?:param|parameter|arg)[ \t]+)([A-Za-z_]\w*)|^[ \t/*#!\"-]*`?([A-Za-z_]\w*)`?[ \t]*(?:\([^)\n]*\))?[ \t]*(?::(?!:)|[-–][ \t])", re.M)
_BLANKS = re.compile(r"\[(?:summary|description|type|name|default|todo|tbd)[^\]]*\]|\b_{1,2}(?:summary|description|type|name|default|notes?)_{1,2}|<(?:summary|/summary|description|placeholder|br|p|hr)[^>]*>|\{\*\}|\b(?:TYPE|DESCRIPTION|SUMMARY|TODO|TBD|FIXME|XXX)\b(?:[.:](?=\s|$))?|\bdescription\b\.?|\$\{?\d*:?\w*\}?|%\w+%|\{\{[^}]*\}\}|&nbsp;")
_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W\d_]+)*")
_UNSPACED = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯]")
_HUMP = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")

_GRAMMAR = r"""
Text <- Part*
Part <- Fence / Rule / Sentence
Fence <- ~(?:```|\~\~\~)[^\n]*\n(?:(?!```|\~\~\~)[\s\S])*(?:(?:```|\~\~\~)[^\n]*|$)~
Rule <- ~[ \t]*[-=_*#/\\+.\~<>|:;!?,]{2,}[ \t]*(?:\n|$)|\n+|[ \t]+(?=\n|$)~
Sentence <- ~(?:[^\n.;!?。！？；]|[.!?;](?=\S)(?![\n]))+[.;!?。！？；]*|[^\n]~
"""
_PEG = Peg(_GRAMMAR, {"Sentence": lambda text, a, b, values: [text[a:b].strip()]}, re.U)


@lru_cache(maxsize=100_000)
def _humps(word: str) -> tuple[str, ...]:
    """The words of an identifier, in lower case."""
    return tuple(x.lower() for part in word.split("_") for x in _HUMP.findall(part))


@lru_cache(maxsize=100_000)
def _stem(word: str) -> str:
    """A word without its ending, alike for replay, replays, replayed and replaying."""
    for end, least in (("ings", 3), ("ing", 3), ("ies", 3), ("ied", 3), ("ers", 4), ("er", 4), ("ors", 4), ("or", 4), ("es", 3), ("ed", 3), ("s", 3)):
        if word.endswith(end) and len(word) - len(end) >= least and not (end == "s" and word.endswith("ss")):
            word = word[: -len(end)]
            break
    if len(word) > 3 and word[-1] in "eyi":
        word = word[:-1]
    return word[:-1] if len(word) > 3 and word[-1] == word[-2] else word


def clauses(doc: str) -> list[str]:
    """The clauses of a documentation without comment marks, fences and rules."""
    lines = []
    for line in doc.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        before = None
        while before != line:
            before, line = line, _MARKS.sub("", line)
        lines.append(line.strip())
    text = "\n".join(lines).strip()
    if _LICENCE_AT.match(text):
        return []
    lines = [x for x in text.split("\n") if x]
    if lines and all(_CODE_LINE.match(x) for x in lines):
        return []
    return _PEG.parse("Text", text)[1]


def _prose(text: str) -> bool:
    """Whether a text behind a tool's name is a sentence rather than rules and codes."""
    words = [w.lower() for w in _WORD.findall(text)]
    return len(words) >= 4 and any(w in GENERAL for w in words)


def informative(name: str | None, signature: str | None, doc: str | None) -> bool:
    """Whether ``doc`` holds a statement of its own. An empty or null one doesn't."""
    if not doc or not doc.strip():
        return False
    own = {_stem(x) for w in _WORD.findall(f"{name or ''} {(signature or '').replace('_', ' ')}") for x in _humps(w)} | {_stem(x) for w in re.findall(r"\w+", f"{name or ''}") for x in _humps(w)}
    own |= {_stem(x) for m in _LABEL.finditer(doc) for w in m.groups() if w for x in _humps(w)}
    for clause in clauses(doc):
        tag = _TAG_AT.match(clause)
        if tag:
            clause = clause[tag.end() :].strip()
        tool = _TOOL_AT.match(clause)
        if tool and not _prose(clause[tool.end() :]):
            continue
        if not clause or tag and len(_WORD.findall(clause)) < 3 or _LICENCE_AT.match(clause) or _UNWRITTEN_AT.match(clause) or _POINTER_AT.match(clause) or _CODE_LINE.match(clause):
            continue
        named = re.match(r"\W{0,3}[\w$.]+\W{0,3}\s*:?\s*", clause)
        if named and _UNWRITTEN_AT.match(clause[named.end() :]) and set(_stem(x) for x in _humps(re.sub(r"\W", "", named.group()))) <= own:
            continue
        rest = _BLANKS.sub(" ", _TAGS.sub(lambda m: f" {m.group(1) or ''} ", clause))
        if len(_UNSPACED.findall(rest)) >= 4:
            return True
        for word in _WORD.findall(rest.replace("_", " ")):
            if word.isdigit():
                continue
            parts = _humps(word) or (word.lower(),)
            if any(len(x) > 1 and x not in GENERAL and _stem(x) not in own and not x.isdigit() for x in parts) and word.lower() not in GENERAL:
                return True
    return False
