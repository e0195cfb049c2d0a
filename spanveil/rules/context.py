"""Names that are recognised by the words before or after them.

Runs of capitalised words are found first; then the words before the name, inside
the run or in front of it, are looked up among the phrases that announce a person.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from spanveil.functions.matching import B0, B1, Reader, Rule
from spanveil.types import CONTEXT_PRIORITY as CONTEXT

_UP, _ANY = r"[A-ZÀ-ɏḀ-ỿ]", r"[a-zA-ZÀ-ɏḀ-ỿ]"
_NAME_WORD = rf"{_UP}(?:{_ANY}|['’-](?={_ANY}))+"
_RUN = re.compile(rf"(?<![A-Za-z0-9_-])(?:(?:Dr|Prof|Mr|Mrs|Ms)\.|{_NAME_WORD})(?:[ \t]+(?:(?:Dr|Prof|Mr|Mrs|Ms)\.|{_NAME_WORD}|{_UP}\.))*")
_WORD = re.compile(r"[^\s]+")

# Verbs, titles and labels that stand before values.
VERBS = (
    "tell", "message", "contact", "call", "text", "notify", "ask", "remind", "inform", "send to", "forward to", "reply to", "thank", "congratulate", "invite",
    "meet with", "schedule with", "speak to", "speak with", "write to", "ping", "dear", "spoke to", "spoke with", "chatted with", "assigned to", "worked with",
    "helped by", "referred by", "connected with", "introduced to", "reported to", "approved by", "reviewed by", "signed by", "authored by", "presented by",
    "interviewed by", "recommended by",
)
TITLES = (
    "CEO", "CTO", "CFO", "COO", "President", "Director", "VP", "Manager", "Lead", "Engineer", "Developer", "Dr.", "Prof.", "Mr.", "Mrs.", "Ms.", "Founder",
    "Co-founder", "Partner", "Chairperson", "Architect", "Consultant", "Analyst", "Specialist", "Officer", "Coordinator", "Representative", "Agent", "Speaker",
    "Presenter", "Attendee", "Assignee", "Reporter", "Author",
)
ORG_SUFFIXES = ("Bank", "Microfinance Bank", "Ltd", "Limited", "Inc", "Incorporated", "PLC", "Corp", "Corporation", "LLC", "GmbH")
INTRODUCTIONS = ("my name is", "my name's", "i am", "i'm", "call me", "myself", "regards", "sincerely", "this is", "managed by", "owned by", "created by", "supervised by", "assigned by")
#: Words that begin no name: small words of English and of what is written about software. Extend it where names are missed or found too often.
NO_NAMES = frozenset(
    """a an and any are as at be been but by can could did do does for from had has have he her here him his how i if in into is it its just let may me might more
    most must my no none not now of off on once one only or other our out over own please she should so some such than that the their them then there these they
    this those to too under until up us very was we were what when where which while who whom why will with would yes yet you your
    account admin api app application bank build card chat city code company config data database date day department device document email error example
    field file form home issue key language library link list mail message model module month name network number order page password phone plan platform
    policy portal private product program project public query report repository request response sample script secret security server service session site
    software source staging street support system table team test text ticket today token tomorrow tool update user value version website week year yesterday""".split()
)
_TRIGGERS = frozenset(x.lower() for x in (*VERBS, *TITLES, *INTRODUCTIONS))
_TRIGGER_ENDS = frozenset(x.split(" ")[-1] for x in _TRIGGERS)
_OPEN_NAME = re.compile(rf"(?i:my\s+name\s+is|my\s+name's|call\s+me)\s{{1,4}}({_ANY}(?:{_ANY}|['’-](?={_ANY}))+)")


def _announced(heard: list[str]) -> bool:
    return heard[-1] in _TRIGGER_ENDS and any(" ".join(heard[-k:]) in _TRIGGERS for k in (1, 2, 3))


def _persons(text: str) -> Iterator[tuple]:
    for run in _RUN.finditer(text):
        at = run.start()
        heard = [w.strip(",").lower() for w in text[max(0, at - 40) : at].split()[-3:]] if at and text[at - 1].isspace() else []
        said = len(heard)
        words = [(at + m.start(), at + m.end()) for m in _WORD.finditer(run.group())]
        for i, (start, end) in enumerate(words):
            word = text[start:end].lower()
            if heard and word not in _TRIGGERS and _announced(heard):
                if word not in NO_NAMES:
                    last = i
                    while last + 1 < len(words) and (low_word := text[slice(*words[last + 1])].lower()) not in NO_NAMES and low_word not in _TRIGGERS:
                        last += 1
                    yield start, words[last][1], "PERSON_NAME", 0.98, CONTEXT, "name after a phrase that announces one", None
                break
            if i > 3 and len(heard) > said + 3:
                break
            heard.append(word)
    if "name" in (low := text.lower()) or "call" in low:
        for m in _OPEN_NAME.finditer(text):
            if m.group(1).lower() not in NO_NAMES:
                yield *m.span(1), "PERSON_NAME", 0.97, CONTEXT, "self-introduction", None


def named(text: str, match: re.Match, group: int) -> bool:
    """The value's first word can be a name."""
    return match.group(group).split()[0].lower() not in NO_NAMES


def _rule(entity_type, pattern, confidence, evidence, marks, priority=CONTEXT, guard=None) -> Rule:
    return Rule(entity_type, pattern, confidence, priority, evidence, (1,), None, "context", marks, guard)


_TITLED = rf"{_UP}[A-Za-z0-9_À-ɏ-]{{1,30}}"
_LAUNCHES = r"(?:launches|launched|launching|rolls\s+out|rolling\s+out|goes\s+live|went\s+live|is\s+releasing|deployed|deploying)"
_SUFFIXES = "|".join(ORG_SUFFIXES)
RULES = (
    Reader("context", _persons),
    _rule("PROJECT_CODENAME", rf"(?<![A-Za-z0-9_-])(?:[Pp]roject|[Ii]nitiative|[Cc]odename|[Oo]peration)(?:\s+(?:[Nn]ame|[Cc]odename))?\s*[:=]?\s*({_TITLED}){B1}", 0.98, "project label", ("project", "initiative", "codename", "operation"), CONTEXT + 10, named),
    _rule("PROJECT_CODENAME", rf"(?<![A-Za-z0-9_-])({_TITLED})\s+{_LAUNCHES}{B1}", 0.98, "launch", ("launch", "roll", "live", "releasing", "deploy"), guard=named),
    _rule("ORGANIZATION", rf"(?<![A-Za-z0-9_-])(?:[Cc]ompany|[Ss]tartup|[Aa]gency|[Ff]irm|[Ee]mployer)\s+(?:called\s+|named\s+)?({_TITLED}){B1}", 0.98, "company before a name", ("company", "startup", "agency", "firm", "employer"), guard=named),
    _rule("ORGANIZATION", rf"{B0}((?:{_UP}[A-Za-z0-9&.'-]{{1,25}}[ \t]+){{1,5}}(?:{_SUFFIXES})){B1}", 0.98, "company suffix", tuple({x.lower() for x in ORG_SUFFIXES}), CONTEXT + 15),
    _rule("ORGANIZATION", rf"{B0}(?i:department\s+of)\s+([A-Z][A-Za-z]{{2,20}}(?:[ \t]+[A-Z][A-Za-z]{{2,20}})?){B1}", 0.96, "department", ("department",)),
    _rule("ORGANIZATION", rf"{B0}([A-Z][A-Za-z]{{2,20}}(?:[ \t]+[A-Z][A-Za-z]{{2,20}})?)\s+[Dd]epartment{B1}", 0.96, "department", ("department",), guard=named),
)
