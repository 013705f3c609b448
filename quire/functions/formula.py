r"""Recognised LaTeX formulas as Spark columns: stray space, empty groups, run-together commands, and formulas that mean nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import WHITE, bound, high_repetition, trim

#: Commands at which a run-together name is parted (fixed values).
COMMANDS = """
cdot cdots ldots dots vdots ddots times div pm mp ast star circ bullet oplus ominus otimes odot
approx equiv neq ne sim simeq cong leq geq le ge ll gg prec succ preceq succeq propto parallel perp
in notin ni subset supset subseteq supseteq cap cup bigcap bigcup emptyset varnothing forall exists nexists neg lnot land lor vee wedge
alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi omicron pi varpi rho varrho sigma varsigma tau upsilon phi varphi chi psi omega
Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega
to gets mapsto rightarrow leftarrow leftrightarrow Rightarrow Leftarrow Leftrightarrow uparrow downarrow longrightarrow longleftarrow longmapsto
sum prod coprod int iint iiint oint bigoplus bigotimes
sin cos tan sec csc cot arcsin arccos arctan sinh cosh tanh log ln lg exp lim liminf limsup sup inf max min arg det dim gcd deg hom ker mod
infty partial nabla prime aleph ell hbar Re Im top bot angle vdash dashv left right big Big bigg Bigg
""".split()

#: Private characters that stand for a blank to keep while others go.
_GAP, _ESCAPED = "\ue000", "\ue001"
#: Backslashes in pairs, not after another one, so that what follows starts a command.
_PAIRS = r"(?<!\\)((?:\\\\)*"


def trimmed_end(latex: Column) -> Column:
    """Without white space and spacing commands at the end."""
    return F.regexp_replace(latex, rf"(?:{WHITE}|\\(?:[,:;!]|quad|qquad|enspace|thinspace))+$", "")


def single_spaced(latex: Column) -> Column:
    """Runs of white space as one blank, also at the ends."""
    return F.regexp_replace(latex, f"{WHITE}+", " ")


def without_empty_groups(latex: Column) -> Column:
    """Without groups that hold nothing or only white space, each with the ^, _ or command before it; so on for groups that become empty."""
    closed = lambda x: F.regexp_replace(x, r"[ \t]*\{\s*\}", "{}")
    # of adjoining groups the first goes first, and the next takes what is then before it
    once = lambda x: F.regexp_replace(closed(x), r"(?:[\^_]|\\[A-Za-z]+)?(?<!\{\})\{\}", "")
    opened = F.length(F.regexp_replace(latex, r"[^{]", ""))
    return F.when(latex.rlike(r"\{\s*\}"), F.aggregate(F.sequence(F.lit(1), F.greatest(opened, F.lit(1))), latex, lambda x, _: once(x))).otherwise(latex)


def parted_commands(latex: Column) -> Column:
    r"""\cdotd as \cdot d: an unknown name that starts with a known one is parted after the longest; names before { stay."""
    known = "|".join(sorted(COMMANDS, key=len, reverse=True))
    return F.regexp_replace(latex, rf"\\(?!(?:{known})(?![A-Za-z]))({known})([A-Za-z]++)(?!\{{)", r"\\$1 $2")


def tight(latex: Column) -> Column:
    """Without blanks, but for one between a command and a letter, and escaped ones."""
    marked = F.regexp_replace(latex, rf"{_PAIRS}\\){WHITE}", f"$1{_ESCAPED}")
    marked = F.regexp_replace(marked, rf"{_PAIRS}\\[A-Za-z]+){WHITE}+(?=[A-Za-z])", f"$1{_GAP}")
    return F.translate(F.regexp_replace(marked, WHITE, ""), _GAP + _ESCAPED, "  ")


def tokens(latex: Column) -> Column:
    """Commands, escaped characters and other characters but white space."""
    return F.regexp_extract_all(latex, F.lit(r"\\[A-Za-z]+|\\[\s\S]?|\S"), 0)


def _most(values: Column) -> Column:
    """How often the most frequent value occurs."""
    return F.coalesce(F.array_max(F.transform(F.array_distinct(values), lambda x: F.size(F.filter(values, lambda y: x == y)))), F.lit(0))


def _count(latex: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(latex, F.lit(pattern), 0))


#: Formulas that mean nothing, whatever else is in them (fixed patterns): a lone command, one short word, placeholders, signs of drawn labels, doubled groups, x/x, labels with an operator.
NOTHING = (
    r"^\\[A-Za-z]+$",
    r"^\\(?:mathrm|textrm|text|operatorname|mathit|mathbf|mathcal|mathsf|mathtt)\{[A-Za-z]{1,6}\}$",
    r"\\square",
    r"(\([^()]{2,15}\))\s*\1",
    r"(\{(?:[^{}]|\{[^{}]*\})+\})\s*\1",
    r"\\frac\{([^{}]+)\}\{\1\}",
    r"(\\[A-Za-z]+|\b[A-Za-z])\s*/\s*\1\b",
    r"^[a-zA-Z]{2,3}_\{\\mathrm\{[a-zA-Z]{3,}\}\}$",
    r"^\\mathrm\{[a-z]{2,}\}[-+][-+]?(?:\\[a-zA-Z]+|[a-zA-Z0-9])$",
    r"\\(?:mathsf|mathtt|texttt)\{",
)


def _means_nothing(t: Column) -> Column:
    """Whether the trimmed formula is too short, repeats tokens, lacks operators or is one of NOTHING."""
    own = tokens(t)
    arguments = F.transform(F.split(F.regexp_extract(t, r"^[A-Za-z\\][A-Za-z]*\(([^()]+)\)$", 1), ","), trim)
    bare = F.regexp_replace(t, r"[\s{}]", "")
    matrix = t.rlike(r"\\begin\{(?:matrix|pmatrix|bmatrix|vmatrix)\}")
    by_tokens = bound(
        own,
        lambda o: (F.size(o) >= 3) & bound(_most(o), lambda often: (often >= 3) & (often >= 0.5 * F.size(o)))
        | F.size(o).between(2, 4) & ~F.exists(o, lambda x: x.rlike(r"^[=+\-/*<>0-9]$"))
        | (F.size(o) <= 12) & (_count(t, r"\\mathrm\{") >= 2) & ~(t.rlike(r"[=+\-*/<>^]") & t.rlike(r"\d")),
    )
    same_arguments = bound(arguments, lambda a: (F.size(a) >= 2) & bound(_most(F.filter(a, lambda x: x != "")), lambda same: (same >= 2) & (same >= 0.5 * F.size(a))))
    tests = [
        F.length(bare) <= 2,
        *[t.rlike(p) for p in NOTHING],
        by_tokens,
        F.replace(bare, F.lit("\\"), F.lit("")).rlike(r"^[-+]?\d+\.?\d*$"),
        same_arguments,
        matrix & (_count(t, r"\\cdots") >= 2),
        t.rlike(r"\\begin\{aligned\}") & ~t.contains("="),
        t.rlike(r"\\begin\{matrix\}") & (_count(t, r"\\downarrow") >= 2),
    ]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def is_trivial(latex: Column) -> Column:
    """Formulas that a recogniser makes of drawings, labels and noise: too short, repeating, without operators, or one of NOTHING. Null gives null."""
    return bound(trim(latex), _means_nothing) | high_repetition(trim(latex))


def cleaned(latex: Column) -> Column:
    """The formula in plain form; empty where it means nothing, null for null."""
    plain = trim(tight(parted_commands(without_empty_groups(single_spaced(trimmed_end(latex))))))
    return F.when(high_repetition(plain), "").otherwise(bound(plain, lambda t: F.when(_means_nothing(t), "").otherwise(t)))
