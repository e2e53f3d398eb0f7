"""Office math (OMML) to LaTeX, one element at a time over the standard library's XML trees."""

from __future__ import annotations

import unicodedata
from xml.etree import ElementTree

M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"

#: Accents, operators with limits, functions, symbols.
ACCENTS = {"̀": "grave", "́": "acute", "̂": "hat", "̃": "tilde", "̄": "bar", "̅": "overline", "̆": "breve", "̇": "dot", "̈": "ddot", "̌": "check", "⃗": "vec", "⃖": "overleftarrow"}
BIG = {"∫": "int", "∬": "iint", "∭": "iiint", "∮": "oint", "∑": "sum", "∏": "prod", "∐": "coprod", "⋃": "bigcup", "⋂": "bigcap", "⋁": "bigvee", "⋀": "bigwedge"}
FUNCTIONS = frozenset("sin cos tan cot sec csc arcsin arccos arctan sinh cosh tanh coth log ln exp lim limsup liminf max min sup inf det dim ker deg gcd arg hom Pr".split())
SYMBOLS = {"×": "times", "÷": "div", "±": "pm", "∓": "mp", "≤": "leq", "≥": "geq", "≠": "neq", "≈": "approx", "≡": "equiv", "∞": "infty", "∂": "partial", "∇": "nabla", "∈": "in", "∉": "notin", "⊂": "subset", "⊆": "subseteq", "∪": "cup", "∩": "cap", "→": "to", "←": "leftarrow", "⇒": "Rightarrow", "⇔": "Leftrightarrow", "∀": "forall", "∃": "exists", "·": "cdot", "⋅": "cdot", "…": "dots", "⋯": "cdots", "∅": "emptyset", "¬": "neg", "∧": "wedge", "∨": "vee", "∝": "propto", "≅": "cong", "⊥": "perp", "∥": "parallel", "∠": "angle"}
BRACES = {"{": "\\{", "}": "\\}", "⟨": "\\langle", "⟩": "\\rangle", "⌊": "\\lfloor", "⌋": "\\rfloor", "⌈": "\\lceil", "⌉": "\\rceil", "‖": "\\|"}


def greek(c: str) -> str | None:
    name = unicodedata.name(c, "")
    if not name.startswith("GREEK ") or " WITH " in name:
        return None
    parts = name.split()
    if len(parts) != 4 or parts[2] != "LETTER":
        return None
    word = parts[3].lower().replace("lamda", "lambda")
    return word.capitalize() if parts[1] == "CAPITAL" else word


def symbol(c: str) -> str:
    """One character; a letter of a mathematical alphabet is its plain letter."""
    if c in SYMBOLS:
        return f"\\{SYMBOLS[c]} "
    if c in BIG:
        return f"\\{BIG[c]} "
    if 0x1D400 <= ord(c) <= 0x1D7FF:
        c = unicodedata.normalize("NFKC", c)
    name = greek(c)
    if name:
        return f"\\{name} "
    return "\\" + c if c in "#%&_$" else c


def _val(e, path: str, default: str | None = None) -> str | None:
    node = e.find(path)
    return default if node is None else node.get(M + "val", default)


class Converter:
    def children(self, e) -> str:
        return "".join(self.convert(c) for c in e)

    def part(self, e, name: str) -> str:
        node = e.find(M + name)
        return "" if node is None else self.children(node).strip()

    def convert(self, e) -> str:
        name = e.tag.rpartition("}")[2]
        if name.endswith("Pr"):
            return ""
        own = getattr(self, "do_" + name, None)
        return own(e) if own else self.children(e)

    def do_r(self, e) -> str:
        text = "".join(t.text or "" for t in e.iter(M + "t"))
        out = "".join(map(symbol, text))
        if e.find(f"{M}rPr/{M}nor") is not None:
            return f"\\text{{{text}}}"
        return out

    def do_f(self, e) -> str:
        kind = _val(e, f"{M}fPr/{M}type", "bar")
        num, den = self.part(e, "num"), self.part(e, "den")
        if kind == "lin":
            return f"{num}/{den}"
        if kind == "skw":
            return f"^{{{num}}}/_{{{den}}}"
        return f"\\genfrac{{}}{{}}{{0pt}}{{}}{{{num}}}{{{den}}}" if kind == "noBar" else f"\\frac{{{num}}}{{{den}}}"

    def do_sSup(self, e) -> str:
        return f"{{{self.part(e, 'e')}}}^{{{self.part(e, 'sup')}}}"

    def do_sSub(self, e) -> str:
        return f"{{{self.part(e, 'e')}}}_{{{self.part(e, 'sub')}}}"

    def do_sSubSup(self, e) -> str:
        return f"{{{self.part(e, 'e')}}}_{{{self.part(e, 'sub')}}}^{{{self.part(e, 'sup')}}}"

    def do_sPre(self, e) -> str:
        return f"{{}}_{{{self.part(e, 'sub')}}}^{{{self.part(e, 'sup')}}}{{{self.part(e, 'e')}}}"

    def do_rad(self, e) -> str:
        deg = self.part(e, "deg")
        return f"\\sqrt[{deg}]{{{self.part(e, 'e')}}}" if deg else f"\\sqrt{{{self.part(e, 'e')}}}"

    def do_d(self, e) -> str:
        left, right, mid = (_val(e, f"{M}dPr/{M}{n}", d) for n, d in (("begChr", "("), ("endChr", ")"), ("sepChr", "|")))
        show = lambda c: BRACES.get(c, c) if c else "."
        inner = f" {BRACES.get(mid, mid)} ".join(self.children(x).strip() for x in e.findall(M + "e"))
        return f"\\left{show(left)} {inner} \\right{show(right)}"

    def do_acc(self, e) -> str:
        return f"\\{ACCENTS.get(_val(e, f'{M}accPr/{M}chr', chr(0x302)), 'hat')}{{{self.part(e, 'e')}}}"

    def do_bar(self, e) -> str:
        return f"\\{'underline' if _val(e, f'{M}barPr/{M}pos', 'bot') == 'bot' else 'overline'}{{{self.part(e, 'e')}}}"

    def do_groupChr(self, e) -> str:
        top = _val(e, f"{M}groupChrPr/{M}pos", "bot") == "top"
        return f"\\{'overbrace' if top else 'underbrace'}{{{self.part(e, 'e')}}}"

    def do_nary(self, e) -> str:
        out = "\\" + BIG.get(_val(e, f"{M}naryPr/{M}chr", "∫"), "int")
        low, high = self.part(e, "sub"), self.part(e, "sup")
        return out + (f"_{{{low}}}" if low else "") + (f"^{{{high}}}" if high else "") + f" {self.part(e, 'e')}"

    def do_func(self, e) -> str:
        name = self.part(e, "fName")
        head = f"\\{name}" if name in FUNCTIONS else name if name.startswith("\\") else f"\\operatorname{{{name}}}"
        return f"{head} {self.part(e, 'e')}"

    def _limit(self, e, mark: str, plain: str) -> str:
        base, lim = self.part(e, "e"), self.part(e, "lim")
        if base in FUNCTIONS:
            return f"\\{base}{mark}{{{lim}}}"
        return f"\\{plain}{{{lim}}}{{{base}}}"

    def do_limLow(self, e) -> str:
        return self._limit(e, "_", "underset")

    def do_limUpp(self, e) -> str:
        return self._limit(e, "^", "overset")

    def do_m(self, e) -> str:
        rows = [" & ".join(self.children(c).strip() for c in r.findall(M + "e")) for r in e.findall(M + "mr")]
        return "\\begin{matrix}" + " \\\\ ".join(rows) + "\\end{matrix}"

    def do_eqArr(self, e) -> str:
        rows = []
        for x in e.findall(M + "e"):
            body, tag, number = self.children(x).strip().rpartition("\\#(")
            rows.append(f"{body}\\tag{{{number[:-1]}}}" if tag and number.endswith(")") else self.children(x).strip())
        return rows[0] if len(rows) == 1 else "\\begin{array}{l}" + " \\\\ ".join(rows) + "\\end{array}"


def omml_to_latex(source) -> str:
    """LaTeX of an OMML element, or of its XML text (which may not have a DOCTYPE)."""
    if isinstance(source, str):
        if "<!DOCTYPE" in source:
            raise ValueError("a document type is not allowed")
        source = ElementTree.fromstring(source)
    return Converter().convert(source).strip()
