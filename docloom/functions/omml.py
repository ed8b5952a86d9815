"""Office math (OMML) as LaTeX: one table of element handlers over an XML tree."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

#: Accents, large operators, symbols and functions.
ACCENTS = {"̀": "grave", "́": "acute", "̂": "hat", "̃": "tilde", "̄": "bar", "̅": "overbar", "̆": "breve", "̇": "dot", "̈": "ddot", "̌": "check", "⃗": "vec", "⃛": "dddot", "⃜": "ddddot", "̱": "underbar", "⏞": "overbrace", "⏟": "underbrace", "⎴": "overbracket", "⎵": "underbracket", "⏜": "overparen", "⏝": "underparen", "̸": "not", "⃖": "overleftarrow", "⃡": "overleftrightarrow"}
OPERATORS = {"⅀": "\\Bbbsum", "∏": "\\prod", "∐": "\\coprod", "∑": "\\sum", "∫": "\\int", "⋀": "\\bigwedge", "⋁": "\\bigvee", "⋂": "\\bigcap", "⋃": "\\bigcup", "⨀": "\\bigodot", "⨁": "\\bigoplus", "⨂": "\\bigotimes"}
GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho varsigma sigma tau upsilon phi chi psi omega partial varepsilon vartheta varkappa varphi varrho varpi".split()
SYMBOLS = {"→": "\\rightarrow ", "←": "\\leftarrow ", "↑": "\\uparrow ", "↓": "\\downarrow ", "↔": "\\leftrightarrow ", "⋮": "\\vdots ", "⋯": "\\cdots ", "⋱": "\\ddots ", "≠": "\\ne ", "≤": "\\leq ", "≥": "\\geq ", "≪": "\\ll ", "≫": "\\gg ", "∈": "\\in ", "∉": "\\notin ", "∋": "\\ni ", "∞": "\\infty ", "±": "\\pm ", "∓": "\\mp "}
SYMBOLS |= {chr(0x1D6FC + i): f"\\{name} " for i, name in enumerate(GREEK)}
# Mathematical italic letters, in Unicode's order.
SYMBOLS |= {chr(0x1D434 + i): chr(ord("A") + i) for i in range(26)} | {chr(0x1D44E + i): chr(ord("a") + i) for i in range(26) if i != 7}
FUNCTIONS = set("sin cos tan arcsin arccos arctan arccot sinh cosh tanh coth sec csc".split())
LIMITS = {"lim", "max", "min"}
FRACTIONS = {"bar": "\\frac{%s}{%s}", "skw": "^{%s}/_{%s}", "noBar": "\\genfrac{}{}{0pt}{}{%s}{%s}", "lin": "{%s}/{%s}"}
ESCAPED = re.compile(r"(?<!\\)([{}_^#&$%~])")


def _name(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2].rpartition(":")[2]


def _setting(node: ET.Element, properties: str, name: str) -> str | None:
    """The m:val of a property; None where it isn't there."""
    for p in node:
        if _name(p) == properties:
            for x in p:
                if _name(x) == name:
                    return next((v for k, v in x.attrib.items() if k.rpartition("}")[2] == "val"), "")
    return None


def _escape(text: str) -> str:
    return ESCAPED.sub(r"\\\1", text)


def _all(node: ET.Element) -> str:
    return "".join(latex(x) for x in node if not _name(x).endswith("Pr"))


def _part(node: ET.Element, name: str) -> str:
    return next((latex(x) for x in node if _name(x) == name), "")


def _parts(node: ET.Element, name: str) -> list[str]:
    return [latex(x) for x in node if _name(x) == name]


def _run(node: ET.Element) -> str:
    said = "".join(x.text or "" for x in node if _name(x) == "t")
    # Commands are kept; only characters of the text itself are escaped.
    return "".join(SYMBOLS.get(x, _escape(x)) for x in said)


def _accent(node: ET.Element) -> str:
    return f"\\{ACCENTS.get(_setting(node, 'accPr', 'chr') or '', 'hat')}{{{_part(node, 'e')}}}"


def _delimited(node: ET.Element) -> str:
    ends = []
    for name, usual in (("begChr", "("), ("endChr", ")")):
        said = _setting(node, "dPr", name)
        ends.append(_escape(SYMBOLS.get(said, said)) if said else "." if said == "" else usual)
    return f"\\left{ends[0]}{'|'.join(_parts(node, 'e'))}\\right{ends[1]}"


def _fraction(node: ET.Element) -> str:
    return FRACTIONS.get(_setting(node, "fPr", "type") or "bar", FRACTIONS["bar"]) % (_part(node, "num"), _part(node, "den"))


def _function(node: ET.Element) -> str:
    name = next((x for x in node if _name(x) == "fName"), None)
    said = _all(name) if name is not None else ""
    return f"\\{said}({_part(node, 'e')})" if said in FUNCTIONS else said + _part(node, "e")


def _root(node: ET.Element) -> str:
    degree = _part(node, "deg")
    return f"\\sqrt[{degree}]{{{_part(node, 'e')}}}" if degree else f"\\sqrt{{{_part(node, 'e')}}}"


def _lower_limit(node: ET.Element) -> str:
    of = _part(node, "e")
    return f"\\{of}_{{{_part(node, 'lim')}}}" if of in LIMITS else of


def _operator(node: ET.Element) -> str:
    sign = _setting(node, "naryPr", "chr")
    return ("\\int" if sign is None else OPERATORS.get(sign, sign)) + _all(node)


HANDLERS = {
    "r": _run,
    "acc": _accent,
    "bar": lambda n: f"\\{'underline' if _setting(n, 'barPr', 'pos') == 'bot' else 'overline'}{{{_part(n, 'e')}}}",
    "d": _delimited,
    "sub": lambda n: f"_{{{_all(n)}}}",
    "sup": lambda n: f"^{{{_all(n)}}}",
    "f": _fraction,
    "func": _function,
    "groupChr": lambda n: f"\\{ACCENTS[c]}{{{_part(n, 'e')}}}" if (c := _setting(n, "groupChrPr", "chr")) in ACCENTS else _part(n, "e"),
    "rad": _root,
    "eqArr": lambda n: "\\begin{array}{c}" + "\\\\".join(_parts(n, "e")) + "\\end{array}",
    "limLow": _lower_limit,
    "limUpp": lambda n: f"\\overset{{{_part(n, 'lim')}}}{{{_part(n, 'e')}}}",
    "lim": lambda n: _all(n).replace("\\rightarrow", "\\to"),
    "m": lambda n: "\\begin{matrix}" + "\\\\".join(_parts(n, "mr")) + "\\end{matrix}",
    "mr": lambda n: "&".join(_parts(n, "e")),
    "nary": _operator,
}


def latex(node: ET.Element) -> str:
    """An element as LaTeX; elements without a handler are their children's."""
    return HANDLERS.get(_name(node), _all)(node)


def omml_to_latex(xml: str) -> str:
    """The first oMath element of XML, whose prefixes need not be declared; empty where there is none."""
    root = parse_fragment(xml)
    first = next((x for x in root.iter() if _name(x) == "oMath"), None)
    return "" if first is None else latex(first)


def parse_fragment(xml: str) -> ET.Element:
    """XML without its declaration under one root that declares the prefixes it uses."""
    bare = re.sub(r"<\?xml[^>]*\?>|<!DOCTYPE[^>\[]*>", "", xml)
    declared = set(re.findall(r"xmlns:(\w+)=", bare))
    used = set(re.findall(r"[<\s/]([A-Za-z][\w.-]*):[A-Za-z]", bare)) - declared - {"xml", "xmlns"}
    return ET.fromstring("<root " + " ".join(f'xmlns:{p}="urn:{p}"' for p in sorted(used)) + f">{bare}</root>")
