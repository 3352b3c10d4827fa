"""Sections of a description: headings carried forward over lines, or paragraphs by clue; and a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import blank, rx

#: What a heading and what a sentence says of its section, in the order in which they are asked.
HEADINGS = {
    "responsibilities": r"\b(responsibilities|what you.ll do|role overview|your role|the role|key duties|duties|about the role|day.to.day|what you will do|position overview)\b",
    "requirements": r"\b(requirements?|qualifications?|must.have|required skills?|what we.re looking for|what you.ll need|you have|you bring|minimum qualifications?|basic qualifications?|skills? required|we need|you should have|what you need|experience required|our ideal candidate|desired qualifications?)\b",
    "nice_to_have": r"\b(nice.to.have|bonus|preferred|plus if you|would be great|bonus points?|it would be great|advantageous|desirable|even better if|extra credit|ideal but not required|we.d love|not required but)\b",
    "benefits": r"\b(benefits?|perks?|compensation|what we offer|why join us|we offer|our offer|what.s in it for you|why work|our package|total rewards?|salary|salary range|working here|why us)\b",
    "company_blurb": r"\b(about us|about the company|who we are|our company|company overview|our mission|the company|our story|what we do|about \w+)\b",
    "legal_eeo": r"\b(equal opportunity|eeo|diversity|inclusion|affirmative action|disability|veteran|accommodation|legal notice|privacy policy|gdpr|right to work|equal employment|non.discrimination)\b",
}
CLUES = {
    "requirements": r"\b(you (must|should|will) (have|possess|know|be)|required|mandatory|must-have|we require|\d\+\s*years? (of )?experience|minimum experience)\b",
    "nice_to_have": r"\b(bonus|preferred|nice to have|ideally|plus|advantageous|not required|desirable|it would be|we.d love)\b",
    "responsibilities": r"\b(you will|you.ll|your job|your responsibilities|responsible for|work on|collaborate with|you.re going to|your tasks|day-to-day)\b",
    "benefits": r"\b(we offer|competitive salary|remote.first|flexible (hours?|schedule)|health insurance|stock options|equity|401k|pto|paid time off|work.from.home|unlimited pto|annual bonus|perks)\b",
    "legal_eeo": r"\b(equal opportunity|eeo|right to work|disability|gdpr|privacy|non.discrimination|all qualified applicants?)\b",
    "company_blurb": r"\b(we are (a|an|the)|our (company|mission|vision|platform|product|team|culture|values)|founded in|headquartered)\b",
}
KNOWN = "requirements qualifications responsibilities benefits perks compensation overview summary about experience skills location salary role".split()
IMPERATIVES = "build maintain write design develop work create implement ensure manage support help drive collaborate adapt transform localize uphold coordinate".split()
PRIORITY = ("requirements", "responsibilities", "nice_to_have", "company_blurb")
MARKER = " [...]"


def _first_of(text: Column, table: dict[str, str]) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(table.items()):
        out = F.when(text.rlike(rx(pattern)), name).otherwise(out)
    return out


def is_heading(line: Column) -> Column:
    """Capitals, a Markdown mark, a known word, or a short capitalised phrase that is no instruction."""
    t = F.regexp_replace(F.trim(line), ":+$", "")
    words = F.size(F.split(t, r"\s+"))
    phrase = words.between(2, 7) & t.rlike(r"^\p{Lu}") & ~t.rlike("[,;()]") & ~F.lower(F.substring_index(t, " ", 1)).isin(*IMPERATIVES)
    return F.length(t).between(3, 80) & ~t.endswith(".") & (t.rlike(r"^(?:[A-Z][A-Z &/'-]{2,}:?|#{1,3}\s+.+)$") | F.lower(t).isin(*KNOWN) | phrase)


def sections(text: Column) -> Column:
    """map<section, text> of a description; an array expression, no explode, so a row stays a row.

    Lines are folded in order: a heading opens a section and later lines join it, blocks of one section are joined.
    Text before any heading is the company's blurb. Without a heading every paragraph is put by its clues.
    """
    lines = F.filter(F.split(blank(text), "\n"), lambda x: F.trim(x) != "")
    state = lambda section, blocks: F.struct(section.alias("section"), blocks.alias("blocks"))
    empty = F.array().cast("array<struct<section:string,line:string>>")

    def fold(acc: Column, line: Column) -> Column:
        head = is_heading(line)
        section = F.when(head, _first_of(line, HEADINGS)).otherwise(acc["section"])
        return state(section, F.concat(acc["blocks"], F.array(F.struct(section.alias("section"), line.alias("line")))))

    headed = F.aggregate(lines, state(F.lit("company_blurb"), empty), fold)["blocks"]
    paragraphs = F.filter(F.transform(F.split(blank(text), r"\n{2,}"), lambda x: F.trim(x)), lambda p: p != "")
    clued = F.transform(paragraphs, lambda p: F.struct(_first_of(p, CLUES).alias("section"), p.alias("line")))
    rows = F.when(F.exists(lines, is_heading), headed).otherwise(clued)
    names = F.array_distinct(F.transform(rows, lambda r: r["section"]))
    joined = F.transform(names, lambda n: F.array_join(F.transform(F.filter(rows, lambda r: r["section"] == n), lambda r: r["line"]), "\n"))
    return F.map_from_arrays(names, joined)


def core_text(text: Column, least: int = 30) -> Column:
    """Requirements, responsibilities and nice-to-haves, or the whole text where these are short."""
    s = sections(text)
    core = F.trim(F.concat_ws(" ", s["requirements"], s["responsibilities"], s["nice_to_have"]))
    return F.when(F.length(core) > least, core).otherwise(blank(text))


def carry_forward(docs: DataFrame, key: str, text: str, heading) -> DataFrame:
    """key, line_no, line, section of every line: the relational form, with the last heading up to each line.

    heading: line -> Column, is it one. The fold runs inside the row, so no window gathers a document's lines.
    """
    lines = F.split(blank(F.col(text)), "\n")
    folded = F.aggregate(
        lines,
        F.struct(F.lit(None).cast("string").alias("section"), F.array().cast("array<struct<line:string,section:string>>").alias("rows")),
        lambda acc, line: F.struct(
            F.when(heading(line), F.trim(line)).otherwise(acc["section"]).alias("section"),
            F.concat(acc["rows"], F.array(F.struct(line.alias("line"), F.when(heading(line), F.trim(line)).otherwise(acc["section"]).alias("section")))).alias("rows"),
        ),
    )["rows"]
    return docs.select(F.col(key), F.posexplode(folded).alias("line_no", "_row")).select(key, "line_no", "_row.line", "_row.section")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.trim(blank(text)), r"\s+"), lambda w: w != "")


def fit_budget(parts: dict[str, Column], budget: int, least: int = 15, marker: str = MARKER) -> Column:
    """struct of the parts cut to a budget of white-space tokens, in order of priority.

    A part that fits is kept whole; one that does not is cut to what is left and marked, if over `least` is left;
    what comes after gets nothing.
    """
    left, out = F.lit(budget), []
    for name, text in parts.items():
        words = words_of(text)
        n = F.size(words)
        whole, cut = n <= left, left > least
        out.append(F.when(n == 0, "").when(whole, F.trim(text)).when(cut, F.concat(F.array_join(F.slice(words, 1, F.greatest(F.lit(1), left - 1)), " "), F.lit(marker))).otherwise("").alias(name))
        left = F.when(n == 0, left).when(whole, left - n).when(cut, F.lit(0)).otherwise(left)
    return F.struct(*out)
