"""Row classifiers: language, seniority, pay, reach and tags, all as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import blank, collapse, contains_any, count_of, has, hits, words_pattern
from sievework.operators.rules import Rule, first_detail, first_match

#: Word lists and patterns of the classifiers, in the order in which they are asked.
STOP_WORDS = {
    "german": "der die das und ist den von zu mit sich des auf für dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind wir ihr du uns".split(),
    "french": "le la les de des du et en est un une que pour dans qui au par sur pas plus avec sont nous vous votre notre vos nos".split(),
    "spanish": "el la de que y en un una los del las por para con no su al lo como pero sus le ya este ha son ellos nosotros más están".split(),
    "english": "the and to of a in is that for you it with on as are be this our we from at or your all have new more an was by".split(),
}
GERMAN_SIGNS = [
    r"\(m/w/d\)",
    r"\(d/m/w\)",
    r"\(w/m/d\)",
    r"\b(deutsch|deutschkenntnisse|fließend deutsch|gute deutschkenntnisse)\b",
    r"\b(wir suchen|deine aufgaben|das bringst du mit|dein profil|unser angebot|bewerbung)\b",
    r"\b(berufserfahrung|erfolgreich|unternehmen|standort|bereich|kenntnisse)\b",
]
WORD = r"(?U)\b[a-zA-ZÀ-ÿ]+\b"
INTERN_TITLE = r"\b(intern|internship|student|working student|werkstudent|praktikant|praktikum)\b"
JUNIOR_TITLE = r"\b(junior|jr\.|entry[- ]level|graduate|associate|trainee|apprentice|early[- ]career)\b"
SENIOR_TITLE = r"\b(senior|sr\.|lead|principal|staff|director|vp|head of|chief|teamlead|teamleitung|architekt|architect|manager)\b"
JUNIOR_BODY = r"\b(0-1|0-2|no prior experience|no experience required|fresh graduate)\b"
SENIOR_BODY = (
    r"\b(?:required|must have|must-have|minimum|you must have)\b.{0,100}\b(?:[7-9]\+|10\+)\s*(?:years?|yrs)\b",
    r"\b(?:[7-9]\+|10\+)\s*(?:years?|yrs)\b.{0,100}\b(?:required|mandatory|minimum|must)\b",
)
MID_BODY = r"\b(3-5|2-4|3\+|2\+)\s*(?:years?|yrs)\b"
UNPAID = (
    r"\b(?:unpaid|non-paid|unvergütet)\s+(?:internship|intern|position|role|job|opportunity|work|contract)\b",
    r"\b(?:this\s+(?:is\s+an?|role\s+is|position\s+is|internship\s+is))\s+(?:unpaid|non-paid|unvergütet)\b",
    r"\b(?:position|role|internship|job)\s+is\s+(?:unpaid|non-paid|unvergütet)\b",
    r"\bunpaid\s+volunteer\b",
    r"\b(?:no\s+compensation|equity\s+only)\b",
    r"^\s*\(?unpaid\)?\b",
    r"\bvolunteer\s+(?:developer|engineer|programmer|intern|position|role)\b",
    r"^\s*\(?volunteer\)?\s+\w+",
)
TECHNOLOGIES = {
    "python": r"\b(python|django|fastapi|flask)\b",
    "javascript": r"\b(javascript|js|es6)\b",
    "typescript": r"\b(typescript|ts)\b",
    "react": r"\b(react|react\.js|reactjs)\b",
    "next.js": r"\b(next\.js|nextjs)\b",
    "node.js": r"\b(node|node\.js|nodejs|express\.js|expressjs)\b",
    "postgresql": r"\b(postgres|postgresql)\b",
    "docker": r"\b(docker|docker-compose)\b",
    "ai/ml": r"\b(ai|ml|machine learning|deep learning|llm|rag|prompt engineering|langchain)\b",
    "flutter": r"\b(flutter|dart)\b",
    "sql": r"\b(sql|mysql|sqlite)\b",
    "git": r"\b(git|github|gitlab)\b",
    "rest-api": r"\b(rest|restful|api)\b",
}
HOME = ("nepal", "kathmandu", "lalitpur")
OPEN_TERMS = ("worldwide", "anywhere", "global", "work from anywhere", "all time zones", "all timezones", "everywhere")
PLACES = (
    "usa|united states|u.s.|us|canada|switzerland|schweiz|suisse|germany|deutschland|france|frankreich|uk|united kingdom|great britain|"
    "australia|ireland|netherlands|spain|espagne|poland|japan|turkey|vietnam|mexico|norway|israel|brazil|argentina|singapore|south korea|"
    "korea|taiwan|new zealand|sweden|denmark|finland|italy|americas|europe|latam|latin america|northern america|berlin|munich|münchen|köln|"
    "cologne|hamburg|bonn|bielefeld|paris|la chaux-de-fonds|mendrisio|homeoffice|amsterdam|london|dublin|tokyo|toronto|vancouver|sydney|"
    "melbourne|san francisco|sf|new york|nyc|seattle|washington|boston|austin|chicago|los angeles|sunnyvale|mountain view|palo alto|san jose|"
    "cupertino|san diego|denver|atlanta|dallas|redmond|cambridge"
).split("|")
REACH_PLACES = ["amer", "americas", "emea", "north america", "na", *PLACES]
ONLY_REGIONS = "us only|usa only|united states only|eu only|europe only|uk only|united kingdom only|canada only|germany only|deutschland only|latam only|france only|brazil only".split("|")
REACH_TEXT = {
    "security_clearance_required": (r"\b(?:security\s+clearance|active\s+clearance|secret\s+clearance|ts/sci|polygraph)\b",),
    "us_citizen_only": (
        r"\b(?:u\.?s\.?\s+citizens?\s+(?:only|or\s+permanent\s+residents?)|u\.?s\.?\s+citizenship\s+required|us\s+citizens?\s+only)\b",
        r"\bto\s+conform\s+to\s+u\.?s\.?\s+government\s+export\s+regulations,\s+applicant\s+must\s+be\s+a\s+u\.?s\.?\s+citizen\b",
    ),
    "work_authorization_required": (
        r"\b(?:work\s+authorization\s+required\s+for|(?:must\s+have|requires?)\s+(?:valid\s+)?work\s+authorization\s+in|(?:authorized|eligible)\s+to\s+work\s+in\s+(?:the\s+)?(?:u\.?s\.?|united\s+states|canada|uk|germany|europe|eu))\b",
    ),
    "regional_restriction": (
        r"anywhere\s+in\s+europe\s+(?:and|or)\s+(?:on\s+)?(?:the\s+)?us\s+east\s+coast",
        r"\banywhere\s+in\s+europe\b",
        r"\b(?:us\s+east\s+coast|eu\s+residents?|europe\s+only|eu\s+only|us\s+only|usa\s+only|uk\s+only|canada\s+only)\b",
    ),
    "timezone": (r"\b(?:gmt-5\s+to\s+gmt\+1|cet\s+timezones?\s+required|gmt\+0\s+to\s+gmt\+2|cet\s*/\s*et)\b",),
}


def language_scores(words: Column, lists: dict[str, list[str]] = STOP_WORDS) -> dict[str, Column]:
    return {lang: count_of(words, set(listed)) for lang, listed in lists.items()}


def decide_language(scores: dict[str, Column], home: str = "english", least: int = 3, rival: int = 5, share: float = 0.8) -> Column:
    """The language with most function words; home under `least`, or unless a rival has enough of them beside it."""
    best = F.greatest(*scores.values())
    others = [k for k in scores if k != home]
    out = F.lit(home)
    for k in reversed(others):
        out = F.when((scores[k] >= rival) & (scores[k] >= scores[home] * share), k).otherwise(out)
    decided = out
    for k in reversed(others):  # ties go to the language named first, home last
        decided = F.when(scores[k] == best, k).otherwise(decided)
    return F.when(best < least, home).otherwise(decided)


def language(title: Column, description: Column, word: str = WORD) -> Column:
    """german, french, spanish or english, from the title and the first 500 characters of the description.

    word: the pattern of the words that are counted, which meets the text in lower case.
    """
    text = F.lower(F.concat(blank(title), F.lit(" "), F.substring(blank(description), 1, 500)))
    words = F.regexp_extract_all(text, F.lit(word), F.lit(0))
    return (
        F.when(has(text, r"\(m/w/d\)|\(w/m/d\)|\(d/m/w\)"), "german")
        .when(has(text, r"\(f/h\)|\(h/f\)"), "french")
        .when(hits(text, GERMAN_SIGNS) >= 2, "german")
        .otherwise(decide_language(language_scores(words)))
    )


def seniority(title: Column, description: Column) -> Column:
    """The title decides; if it says nothing, the description may, with less trust."""
    d = F.lower(blank(description))
    rules = [
        Rule("intern", has(title, INTERN_TITLE)),
        Rule("junior", has(title, JUNIOR_TITLE)),
        Rule("senior", has(title, SENIOR_TITLE)),
        Rule("junior", has(d, JUNIOR_BODY)),
        Rule("senior", has(d, *SENIOR_BODY)),
        Rule("mid", has(d, MID_BODY)),
    ]
    return first_match(rules, "unspecified")


def unpaid(title: Column, description: Column) -> Column:
    return has(F.concat_ws(" ", blank(title), blank(description)), *UNPAID)


def access(title: Column, remote: Column, location: Column, restriction: Column) -> Column:
    """ACCESSIBLE, BLOCKED or UNKNOWN."""
    loc, restr = F.trim(blank(location)), F.trim(blank(restriction))
    near = F.lower(F.when(F.lower(restr) == "worldwide", F.concat(loc, F.lit(" worldwide"))).when(F.lower(restr).isin("remote", "unspecified"), loc).otherwise(F.concat_ws(" ", loc, restr)))
    rules = [
        Rule("BLOCKED", has(F.upper(blank(title)), words_pattern(["EMEA", "NA", "EU", "US", "USA", "LATAM"]), fold=False)),
        Rule("ACCESSIBLE", contains_any(near, HOME)),
        Rule("ACCESSIBLE", contains_any(near, OPEN_TERMS)),
        Rule("BLOCKED", ~F.coalesce(remote, F.lit(False))),
        Rule("BLOCKED", contains_any(near, ("(hybrid)", "(onsite)", "hybrid"))),
        Rule("BLOCKED", has(near, words_pattern(PLACES), fold=False)),
    ]
    return first_match(rules, "UNKNOWN")


def open_to_home(remote: Column, location: Column, restriction: Column) -> Column:
    """The older yes-or-no form of access()."""
    near = F.lower(F.concat_ws(" ", blank(location), blank(restriction)))
    return contains_any(near, HOME) | (F.coalesce(remote, F.lit(False)) & ~has(near, words_pattern(ONLY_REGIONS), fold=False))


def reach(title: Column, description: Column, location: Column, restriction: Column, remote: Column) -> Column:
    """struct<reason, detail>: accessible, unknown or blocked, and why; eight blocks of rules, the first decides."""
    plain = lambda c: F.regexp_replace(F.replace(F.lower(c), F.lit("&nbsp;"), F.lit(" ")), r"(?U)[\s\u00a0]+", " ")
    desc, near = plain(blank(description)), plain(F.concat_ws(" ", F.trim(blank(location)), F.trim(blank(restriction))))
    upper = F.upper(blank(title))
    rule = lambda state, why, when: Rule(state, when, detail=F.lit(why))
    rules = [rule("blocked", "itar_requirement", has(F.concat_ws(" ", blank(title), blank(description)), r"\bITAR\b"))]
    rules += [rule("blocked", why, has(desc, *patterns)) for why, patterns in REACH_TEXT.items()]
    rules += [
        rule("blocked", "title_region_code", has(upper, words_pattern(["EMEA", "NA", "EU", "US", "USA", "LATAM", "AMER"]), fold=False) & ~contains_any(upper, ("APAC", "GLOBAL", "WORLDWIDE"))),
        rule("accessible", "can_be_executed_globally", desc.contains("can be executed globally")),
        rule("accessible", "home_explicit", contains_any(desc, HOME) | contains_any(near, HOME)),
        rule("accessible", "explicit_worldwide_location", contains_any(near, ("worldwide", "work from anywhere", "anywhere in the world"))),
        rule("accessible", "worldwide_in_description", contains_any(desc, ("remote (worldwide)", "remote(worldwide)"))),
        rule("blocked", "onsite_abroad", ~F.coalesce(remote, F.lit(False))),
        rule("blocked", "hybrid_requires_local_presence", contains_any(near, ("(hybrid)", "(onsite)", "hybrid"))),
        rule("blocked", "location_excludes_home", has(near, words_pattern(REACH_PLACES), fold=False)),
    ]
    return F.coalesce(first_detail(rules), F.struct(F.lit("unknown").alias("reason"), F.lit("no_location_restriction_stated").alias("detail")))


def tech_tags(title: Column, description: Column, tags: Column) -> Column:
    """Existing tags and the technologies named, as a sorted set."""
    text = F.lower(F.concat_ws(" ", blank(title), blank(description)))
    found = F.array_compact(F.array(*[F.when(has(text, p), name) for name, p in TECHNOLOGIES.items()]))
    kept = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda t: t != "")
    return F.array_sort(F.array_distinct(F.concat(kept, found)))


def enrich(postings: DataFrame, word: str = WORD) -> DataFrame:
    """Add all classifications to postings: one projection, no shuffle, no Python. word: see language()."""
    c = F.col
    r = reach(c("title"), c("description_text"), c("location_raw"), c("remote_restriction"), c("is_remote"))
    return postings.withColumns(
        {
            "detected_language": language(c("title"), c("description_text"), word),
            "experience_level": seniority(c("title"), c("description_text")),
            "is_unpaid": unpaid(c("title"), c("description_text")),
            "open_to_home": open_to_home(c("is_remote"), c("location_raw"), c("remote_restriction")),
            "accessibility": access(c("title"), c("is_remote"), c("location_raw"), c("remote_restriction")),
            "reach": r["reason"],
            "reach_reason": r["detail"],
            "tags": tech_tags(c("title"), c("description_text"), c("tags")),
        }
    )
