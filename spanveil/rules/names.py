"""Persons, places and organisations from lists of known names.

Words of a text are looked up, alone and in runs, in hash tables: one pass, whatever
the size of the lists. Short acronyms must be written in capitals; accents are folded.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from spanveil.functions.matching import Reader
from spanveil.rules.context import NO_NAMES, ORG_SUFFIXES
from spanveil.types import NAME_PRIORITY

# Given names (accented letters are folded, so each is listed once).
GIVEN = """Aaliya Kofi Kwame Zola Chidi Amara Nneka Ngozi Tunde Jabari Sekou Tariq Malik Zainab Fatima Youssef Bilal Omar Amina Rashid Khadija Adeniyi Oluwanimofe Shalom
Oluwaseun Ayomide Temitope Damilola Chioma Amadi Bisi Femi Kelechi Emeka Nnamdi Simi Yetunde Folake Kunle Segun Ming Ren Hiroshi Wei Mei Kenji Priya Aarav Ananya Rohan Yuki Chen Li
Zhang Siddharth Tanaka Nguyen Kim Park Satoshi Sakura John Jane Alexander Sarah Robert Emily David Michael Carlos Elena Mateo Sofia Lucas Isabella Gabriel Camila Marcus Chloe Oliver
Emma Han James William Daniel Matthew Anthony Elizabeth Sophia Mia Ava Alex Morgan Jessica Karen Lisa Laura Shirley Angela Anna Brenda Nicole Samantha Katherine Taylor Victoria
Abigail Rachel Justin Brandon Jeff Jeffrey Jeffery Thomas Tom Samuel Sam Christopher Chris Paul Mark Benjamin Ben Timothy Tim François Dubois Benoît Hélène Jérôme Élodie Sébastien
Gérard Thierry Alain Pierre Jean Marc Luc Jacques Antoine Guillaume Étienne Stéphane Aurélie Céline"""
# Surnames.
SURNAMES = """Okafor Bello Adeyemi Odunlade Adeniyi Oluwanimofe Shalom Mensah Diallo Kamara Balogun Nwachukwu Chukwu Toure Adewale Adeleke Adebanjo Oladipo Okonkwo Eze Nwosu Obi Odeh
Danjuma Gowon Sow Kone Diop Keita Traore Bah Sesay Kanu Koroma Mwangi Ochieng Otieno Kariuki Njoroge Kamau Kipchoge Kimani Waweru Kiptoo Mutua Abubakar Dubois Dupont Martin Bernard
Thomas Petit Robert Richard Durand Moreau Laurent Simon Michel Lefebvre Leroy Roux David Bertrand Morel Fournier Girard Bonnet Dupuis Fontaine Rousseau Vincent Muller Lambert Faure
Mercier Blanc Guerin Boyer Garnier Chevalier Francois Doe Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Taylor
Moore Jackson Lee Perez Thompson White Harris Sanchez Clark Ramirez Lewis Robinson Walker Young Allen King Wright Scott Torres Nguyen Hill Flores Green Adams Nelson Baker Hall Rivera
Campbell Mitchell Kowalski Novak Schneider Fischer Weber Meyer Wagner Becker Mueller Jenkins Patel Sharma Gupta Singh Wang Li Zhang Chen Liu Yang Huang Zhao Al-Mansoor Ibrahim
Hussein Ali Khan Ahmed Rahman Siddiqui Malik Hassan"""
# Entity type, confidence, and names of places, organisations, projects and repositories.
PHRASES = (
    ("PROJECT_CODENAME", 0.95, "Titan, Apollo, Falcon, Phoenix, TrackPricely, MOAA, Privacy Layer, SentinelMask"),
    ("REPOSITORY", 0.95, "Repository Sentinel, repo aquire1, privacy-layer, sentinel-core, masking-engine"),
    ("LOCATION", 0.94, "United States, USA, US, Canada, United Kingdom, UK, Germany, France, Japan, China, India, Brazil, Kenya, Nigeria, South Africa, Australia, Singapore, United Arab Emirates, UAE, Saudi Arabia, Israel, Mexico, Spain, Italy, Netherlands, Sweden, Switzerland, South Korea, Indonesia, Egypt, Argentina, Chile, Colombia"),
    ("LOCATION", 0.93, "California, New York, Texas, Florida, Illinois, Pennsylvania, Ohio, Georgia, North Carolina, Michigan, Ontario, Quebec, Bavaria, Maharashtra, Tokyo-to"),
    ("LOCATION", 0.93, "New York, London, Tokyo, Nairobi, Paris, Berlin, Toronto, Sydney, San Francisco, Dubai, Lagos, Cairo, Mumbai, Austin, Singapore, Chicago, Los Angeles, Seattle, Boston, Amsterdam, Seoul, Beijing, Shanghai, Bangalore, Tel Aviv, Hong Kong"),
    ("LOCATION", 0.91, "EMEA, APAC, Silicon Valley, Bay Area, West Coast, East Coast, LATAM, Sub-Saharan Africa, Middle East, North America, Western Europe, Southeast Asia, Nordics"),
    ("ORGANIZATION", 0.94, "Acme, Acme Corp, Microsoft, Google, Apple, Amazon, Meta, Netflix, OpenAI, Anthropic, Stripe, Vercel, Linear, Datadog, Snowflake, Palantir, Cloudflare, NASA, United Nations, UN, WHO, FBI, UNICEF, W3C, ISO, CERN"),
    ("ORGANIZATION", 0.92, "Human Resources, HR, R&D, Research & Development, Information Technology, IT, DevOps, Department of Sales, Sales Department, Department of Engineering, Engineering Department, Department of Marketing, Marketing Department, Department of Finance, Finance Department, Department of Legal, Legal Department, Department of Operations, Operations Department"),
    ("ORGANIZATION", 0.95, "Harvard, Harvard University, Stanford, Stanford University, MIT, Massachusetts Institute of Technology, Oxford, University of Oxford, Cambridge, University of Cambridge, UC Berkeley, Columbia University, Yale, Princeton"),
)
_WORD = re.compile(r"(?<!\w)[^\W_]+(?:[&'’.-]?[^\W_]+)*(?!\w)|&")
# Titles of states, before their names and at the head of a line; words of official documents, at their top.
STATE_TITLES = (
    "federal republic of", "republic of", "kingdom of", "commonwealth of", "united states of", "united kingdom", "people's republic of", "people’s republic of", "emirates of", "government of", "state of",
    "department of", "ministry of",
)
STATE_LINES = ("federal republic", "republic of", "kingdom of", "government of", "commonwealth", "state of")
OFFICIAL = (
    "federal republic", "republic of", "kingdom of", "government", "commission", "ministry", "department", "smart card", "official", "national identity", "civil registration", "passport", "certificate",
)
#: Titles count so far before a name, and so far after their own end; the top of a document is so long.
BEFORE, AFTER_TITLE, TOP = 80, 40, 350
_COMMENT = re.compile(r"\s*(?:#|//|/\*|--)")
_SUFFIX_WORDS = frozenset(w.lower() for s in ORG_SUFFIXES for w in s.split())


def folded(word: str) -> str:
    """Without accents, possessive and case."""
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("’", "'")
    return word.lower().removesuffix("'s")


# Words that are no given names before a surname.
NO_FIRST = """contact please primary lead target tell email send meet dear from to ask call message inform reply forward schedule ping use password key secret token is was are were will be
at for in on by with and or of this that our my your his her their launches launching launched rolls rolling rolled goes went starts starting ends ending releases releasing ships
shipping arrives leaves backup"""
_NO_FIRST = frozenset(NO_FIRST.split())
_GIVEN, _SURNAMES = (frozenset(map(folded, x.split())) for x in (GIVEN, SURNAMES))
_PHRASES = {folded(" ".join(_WORD.findall(name))): (name, kind, confidence) for kind, confidence, names in reversed(PHRASES) for name in names.split(", ")}
_LONGEST = max(x.count(" ") + 1 for x in _PHRASES)
_STARTS = frozenset(x.split(" ")[0] for x in _PHRASES)


def _line_of(text: str, at: int) -> str:
    end = text.find("\n", at)
    return text[text.rfind("\n", 0, at) + 1 : end if end >= 0 else len(text)]


def _blanked(text: str) -> str:
    return " ".join(text.lower().split())


def _state_title(text: str, start: int) -> bool:
    """Does a place stand in the title of a state or of one of its offices, or at the top of an official document?"""
    before = _blanked(text[max(0, start - BEFORE) : start]) + " "
    if any((at := before.rfind(t + " ")) >= 0 and len(before) - at - len(t) <= AFTER_TITLE for t in STATE_TITLES):
        return True
    line = _blanked(_line_of(text, start))
    if any(t + " " in line for t in STATE_LINES):
        return True
    return start < TOP and any(w in _blanked(text[:TOP]) for w in OFFICIAL)


def _spared(text: str, start: int, kind: str) -> bool:
    """Organisations in comments of code, and places in official titles, are no finds."""
    if kind == "ORGANIZATION":
        line = _line_of(text, start)
        return bool(_COMMENT.match(line)) and not any(w.lower() in _SUFFIX_WORDS for w in line.split())
    return kind == "LOCATION" and _state_title(text, start)


_INTEREST = _STARTS | _GIVEN | _SURNAMES


def _key(word: str) -> str:
    return word.lower() if word.isascii() and "'" not in word else folded(word)


def known_names(text: str) -> Iterator[tuple]:
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    keys = [_key(w) for _, _, w in words]
    joined = lambda i, k: all(text[words[j][1] : words[j + 1][0]].strip(" \t") == "" for j in range(i, k))
    free = 0
    for i in [i for i, k in enumerate(keys) if k in _INTEREST]:
        if i < free:
            continue
        if keys[i] in _STARTS:
            for n in range(min(_LONGEST, len(words) - i), 0, -1):
                found = _PHRASES.get(" ".join(keys[i : i + n]))
                if found and joined(i, i + n - 1):
                    start, end = words[i][0], words[i + n - 1][1]
                    exact = len(found[0]) > 3 or text[start:end].removesuffix("'s") == found[0]
                    if exact and not _spared(text, start, found[1]):
                        yield start, end, found[1], found[2], NAME_PRIORITY, "known name", None
                        free = i + n
                        break
        if i >= free and keys[i] in _GIVEN and words[i][2][0].isupper():
            following = words[i + 1] if i + 1 < len(words) and joined(i, i + 1) and words[i + 1][2][0].isupper() else None
            company = any(k in _SUFFIX_WORDS for k in keys[i + 1 : i + 3])
            if following and keys[i + 1] in _SURNAMES and not (i + 2 < len(words) and keys[i + 2] in _SUFFIX_WORDS):
                yield words[i][0], following[1], "PERSON_NAME", 0.96, NAME_PRIORITY, "known given name and surname", None
                free = i + 2
            elif not company:
                longer = following and keys[i + 1] not in NO_NAMES and not words[i][2].lower().endswith("'s")
                yield words[i][0], (following[1] if longer else words[i][1]), "PERSON_NAME", 0.92, NAME_PRIORITY, "known given name", None
                free = i + 2 if longer else i + 1
        elif free < i and keys[i] in _SURNAMES and joined(i - 1, i) and all(w[2][0].isupper() and len(w[2]) > 1 for w in words[i - 1 : i + 1]):
            # a surname tells a name whose first word nobody knows; the word before must be able to be one
            apart = keys[i - 1] not in NO_NAMES and keys[i - 1] not in _NO_FIRST and _SUFFIX_WORDS.isdisjoint(keys[i - 1 : i + 2])
            if apart and words[i - 1][2].isalpha():
                yield words[i - 1][0], words[i][1], "PERSON_NAME", 0.96, NAME_PRIORITY, "known surname after a word", None
                free = i + 1


READER = Reader("names", known_names)
