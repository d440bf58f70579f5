"""Companies, contacts and areas as texts name them, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brickwork.functions.names import any_keyword, squeeze

# Fixed values, from here to SCOTTISH_AREAS: what names look like, and words that no name holds.

SUFFIX_WORDS = (
    r"Ltd\.?|Limited|Plc|PLC|LLP|CIC|CIO|Inc|Group|(?:Housing\s+)?Association|Society|Trust|Foundation|Co-operative|"
    r"(?:Services|Management|Housing|Homes|Living|Maintenance|Solutions|Consulting)(?:\s+(?:Ltd\.?|Limited|Plc|PLC|LLP|CIC|Group))?"
)
INVESTOR_WORDS = r"Capital|Partners|Advisors|Advisers|Investment(?:s)?|REIT|Asset\s+Management"
COMPANY = rf"([A-Z][A-Za-z0-9\s&'.\-]{{3,78}}?\b(?:{SUFFIX_WORDS}))\b"
INVESTOR = rf"([A-Z][A-Za-z0-9\s&'.\-]{{3,78}}?\b(?:{SUFFIX_WORDS}|{INVESTOR_WORDS}))\b"
OPERATOR_PATTERNS = [
    rf"(?i)(?:awarded|appointed|selected|contracted)\s+to\s+{COMPANY}",
    rf"(?i)(?:contract|agreement|arrangement)\s+with\s+{COMPANY}",
    rf"(?i)(?:managed|operated|delivered|provided|run)\s+by\s+{COMPANY}",
    rf"(?i)(?:provider|operator|supplier|contractor|manager)\s+(?:is|will be|shall be)\s+{COMPANY}",
    rf"(?i)(?:incumbent|current\s+(?:provider|operator|contractor|supplier))[\s:]+{COMPANY}",
]
MANAGER_PATTERNS = [
    rf"(?i)asset\s+manag(?:er|ement)\s+(?:is|by|provided by|:)\s+{INVESTOR}",
    rf"(?i)(?:asset\s+manager|AM\s+provider|asset\s+management\s+(?:company|provider|firm))[\s:]+{INVESTOR}",
    rf"(?i)(?:fund\s+manager|investment\s+manager)[\s:]+{INVESTOR}",
]
NOT_IN_NAMES = [
    "required", "suitably", "qualified", "experienced", "provision", "provide", "ensure", "undertake", "carry out", "responsible", "the council",
    "the authority", "the client", "we are", "will be", "contractors to", "services to", "services for", "this contract", "in accordance",
    "as part of", "as set out", "in relation to", "including but", "minimum of", "maximum of", "a range of", "the programme", "the service",
    "this is", "split into", "be responsible", "full details", "related to", "scope of", "all housing", "range of housing", "and be responsible",
]
SENTENCE_GOES_ON = r"(?i)[,.]?\s+(?:the|this|and|or|a|an|is|are|was|were|will|shall|has|have|which|that|who|where|full|for|to|in|on|at|by|of|we|it)\s"
NEXT_SENTENCE = r"\.\s+[A-Z]"
NO_COMPANY = [
    r"^\d{4}/\d+",
    r"(?i)^(http|www\.|ocds-|ocid)",
    r"(?i)Notice identifier|Published \d|view related|Watch this notice",
    r"(?i)^(?:the|a|an|to|for|in|on|at|by|of|with|from|and|or|is|are|was|were|this|that|it|we|our|all|any|its|their|these|those)\s",
    r"(?i)^(?:required|suitably|qualified|provide|ensure|carry|including|minimum|maximum|various|several|appropriate|necessary|relevant)\b",
    r"^\p{Ll}",
]
TITLE_WORDS = [
    "director", "head of", "managing", "asset manag", "development", "operations", "ceo", "coo", "chief", "btr", "build to rent", "investment",
    "portfolio", "residential", "living",
]
#: Titles that hold none of the words above and count all the same.
TITLES = ["fund manager"]
AREA_ALIASES = {
    "bristol, city of": "bristol", "kingston upon hull, city of": "kingston upon hull", "herefordshire, county of": "herefordshire",
    "st. helens": "st helens", "st. albans": "st albans",
}
SCOTTISH_AREAS = {
    "aberdeen and shire": ["Aberdeen City", "Aberdeenshire"], "argyll and bute": ["Argyll and Bute"],
    "ayrshires": ["North Ayrshire", "South Ayrshire", "East Ayrshire"], "dumfries and galloway": ["Dumfries and Galloway"],
    "dundee and angus": ["Dundee City", "Angus"], "east dunbartonshire": ["East Dunbartonshire"], "fife": ["Fife"],
    "forth valley": ["Falkirk", "Stirling", "Clackmannanshire"],
    "greater glasgow": ["Glasgow City", "Renfrewshire", "East Renfrewshire", "Inverclyde", "West Dunbartonshire"],
    "highland and islands": ["Highland", "Moray", "Na h-Eileanan Siar", "Orkney Islands", "Shetland Islands"],
    "lothian": ["City of Edinburgh", "East Lothian", "Midlothian", "West Lothian"], "north lanarkshire": ["North Lanarkshire"],
    "perth and kinross": ["Perth and Kinross"], "scottish borders": ["Scottish Borders"], "south lanarkshire": ["South Lanarkshire"],
    "west lothian": ["West Lothian"],
}


def valid_company(name: Column) -> Column:
    """Whether a text can be a company's name: 3 to 120 characters, two in five of them letters, none of the shapes of other texts; false for null."""
    text = F.trim(name)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    shaped = [~F.rlike(text, F.lit(p)) for p in NO_COMPANY]
    return F.coalesce(F.length(text).between(3, 120) & (letters >= F.length(text) * 0.4) & reduce(lambda a, b: a & b, shaped), F.lit(False))


def named_company(text: Column, patterns: list[str]) -> Column:
    """The company behind the first pattern whose catch, cut where the sentence goes on, can be a name of at most eight words; null without any."""
    cut = lambda name, at: F.get(F.split(name, at, 2), F.lit(0))
    clean = lambda name: F.regexp_replace(F.trim(cut(cut(F.trim(name), SENTENCE_GOES_ON), NEXT_SENTENCE)), r"[.,;:]+$", "")
    fits = lambda name: valid_company(name) & (F.length(name) >= 5) & ~any_keyword(F.lower(name), NOT_IN_NAMES) & (F.size(F.split(squeeze(name), " ")) <= 8)
    found = F.array(*[F.regexp_extract(text, p, 1) for p in patterns])
    return F.get(F.filter(F.transform(found, clean), fits), F.lit(0))


def named_operator(text: Column) -> Column:
    return named_company(text, OPERATOR_PATTERNS)


def named_manager(text: Column) -> Column:
    return named_company(text, MANAGER_PATTERNS)


def relevant_title(title: Column) -> Column:
    """Whether a contact with this job title decides on business; false for null."""
    text = F.lower(title)
    return F.coalesce(any_keyword(text, TITLE_WORDS) | text.isin(TITLES), F.lit(False))


def contact_key(email: Column, name: Column) -> Column:
    """What makes a contact the same across sources: the address, else the name."""
    return F.lower(F.trim(F.coalesce(F.nullif(email, F.lit("")), name)))


def area_name(name: Column) -> Column:
    """An area's name as a key: aliases, then letters alone without 'city of', 'county of', 'the'; null counts as empty."""
    text = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    known = F.create_map(*[F.lit(x) for pair in AREA_ALIASES.items() for x in pair])
    plain = F.regexp_replace(F.coalesce(F.try_element_at(known, text), text), r"\b(city of|county of|the)\b", " ")
    return squeeze(F.regexp_replace(plain, "[^a-z ]", " "))


#: Fixed value: what sites add to the names of their pages.
SITE_NAMES = (
    r"(?i)\s*[|\-–—]\s*(yugo|hello student.*|host.*|study inn.*|abodus.*|iq student.*|student roost.*|mezzino.*|downing students.*|collegiate.*|prestige student living.*|vita student.*|"
    r"crm students.*|book direct.*|student accommodation.*)\s*$"
)
#: Character references in titles and descriptions.
REFERENCES = {"&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&amp;": "&"}


def plain(text: Column) -> Column:
    """Character references decoded, white space single."""
    for reference, sign in REFERENCES.items():
        text = F.replace(text, F.lit(reference), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def page_title(html: Column) -> Column:
    return plain(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_heading(html: Column) -> Column:
    """The first heading, without the markup in it."""
    return plain(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", " "))


def page_meta(html: Column, name: str) -> Column:
    """The content of a meta element with this name or property; empty without one."""
    return plain(F.regexp_extract(html, rf"(?is)<meta\s[^>]*(?:name|property)=[\"']{name}[\"'][^>]*?content=[\"'](.*?)[\"']", 1))


def site_free(name: Column, times: int = 3) -> Column:
    """A page's name without what its site adds, up to ``times`` over."""
    for _ in range(times):
        name = F.trim(F.regexp_replace(name, SITE_NAMES, ""))
    return F.trim(F.regexp_replace(name, r"^[ ,|\-–]+|[ ,|\-–]+$", ""))
