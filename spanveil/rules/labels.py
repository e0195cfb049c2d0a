"""Values after a label: ``Label: value`` or ``label = value``, anywhere in a text.

A label set, a class of values and what the value is make one rule. Labels are looked
up by the words before each separator, so that a text is read once, however many
labels there are. In a label ``(s)`` may be left out and ``[cs]`` is any of the letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

from spanveil.functions.matching import Reader
from spanveil.rules.context import NO_NAMES
from spanveil.types import CONTEXT_PRIORITY as CONTEXT
from spanveil.types import REGEX_PRIORITY as REGEX

#: Classes of values.
CLASSES = {
    "line": r"[^\"'\r\n;|]+",
    "id": r"[A-Za-z0-9\-_/#]{3,}",
    "number": r"[A-Za-z0-9-]*[0-9][A-Za-z0-9-]*(?:[ \t]+[A-Za-z0-9-]*[0-9][A-Za-z0-9-]*)*|[A-Za-z0-9]{4,}",
    "digits": r"[0-9][0-9 -]+[0-9]",
    "phone": r"[+0-9 .()-]{7,}",
    "mail": r"[A-Za-z0-9._%+-]+\s*(?:@|\[at\]|\(at\))\s*[A-Za-z0-9.-]+\s*\.\s*[A-Za-z]{2,}",
    "word": r"[^\s\"';,<>]{2,}",
    "secret": r"[^\s\"';,]{4,}",
    "handle": r"[A-Za-z0-9_.À-ɏḀ-ỿ'’-]{2,}(?:[ \t]+[A-ZÀ-ɏḀ-ỿ][A-Za-zÀ-ɏḀ-ỿ'’-]+){0,3}",
    "title": r"[A-Za-z0-9&.'À-ɏ-]{2,}(?:[ \t]+[A-Za-z0-9&.'À-ɏ-]+){0,5}",
    "path": r"[A-Za-z0-9_./-]{2,}",
    "mac": r"[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}",
    "address": r"[^\n\r;]+(?:\r?\n[ \t]+[^\n\r;]+)?",
}
# Entity type, class of values, confidence, priority, prefix of placeholders, labels.
LABELS = (
    ("PERSON_NAME", "handle", 0.99, CONTEXT, None, "name, full name, full_name, first name, first_name, last name, last_name, user, username, client, customer, patient, doctor, physician, contact, author, owner, admin, member, agent, caller, recipient, sender, subscriber, assignee, creator, handle, nickname, alias, identity"),
    ("EMAIL_ADDRESS", "mail", 0.99, REGEX + 10, None, "e-mail, email, e-mail address, email address, email id, personal email, work email, primary email"),
    ("ADDRESS", "address", 0.98, CONTEXT + 15, None, "address, physical address, street address, billing address, shipping address, home address, residential address, office address, work address"),
    ("REPOSITORY", "path", 0.98, CONTEXT, None, "repository, repository name, repo, repo name, codebase, git repo"),
    ("ORGANIZATION", "title", 0.99, REGEX + 20, None, "bank, bank name, company, company name, organization, organization name, org, institution, agency, business, employer, firm, university, college, school, hospital, clinic, ministry, authority, foundation, association"),
    ("SSN_NATIONAL_ID", "id", 0.99, REGEX + 20, None, "national identification number, national identification number (nin), national identity number, national id, nin, ssn, social security, social security number, driver's license, driver's license number, voter id, student id, state id, civil id, resident id, tax id"),
    ("BANK_ACCOUNT", "number", 0.99, REGEX + 20, None, "bank verification, bank verification number, bank verification number (bvn), bvn, bvn number"),
    ("PHONE_NUMBER", "phone", 0.99, REGEX + 10, None, "phone, phone number, telephone, tel, mobile, mobile number, cell, cell phone, contact number, contact phone, hotline, whatsapp, fax"),
    ("BANK_ACCOUNT", "number", 0.99, REGEX + 15, None, "bank account, bank account number, routing number, sort code, account number, acct no, acct no., iban, swift, swift code, bic"),
    ("SSN_NATIONAL_ID", "id", 0.95, CONTEXT, None, "user id, account id, customer id, client id, member id, patient id, subscriber id, ticket id"),
    ("EMPLOYEE_ID", "id", 0.98, REGEX + 10, "EMPLOYEE", "employee id, staff id, badge number, worker id, personnel number"),
    ("PASSPORT_NUMBER", "id", 0.99, REGEX + 15, "PASSPORT", "passport number, passport no, passport no., passport #, visa record(s), visa number, work permit(s), work authorization, ead number, passport stamp(s)"),
    ("CREDIT_CARD", "digits", 0.99, REGEX + 15, "CREDIT_CARD", "credit card, credit card number, credit card information, debit card, debit card number, card number, cvv, cvc, card verification"),
    ("FINANCIAL_METRIC", "line", 0.98, REGEX + 15, "FINANCIAL", "investment portfolio, portfolio value, stock holding(s), shareholding(s), equity stake, asset(s) under management, loan record(s), loan amount, loan balance, mortgage, mortgage balance, payment history, billing record, transaction history, online purchase record(s), order history, shopping history, cart total, political donation(s), campaign contribution, religious contribution(s), tithe, zakat, salary, salary information, annual salary, base salary, monthly salary, hourly rate, wage, compensation, bonus, stipend"),
    ("URL", "word", 0.98, REGEX + 10, "URL", "personal website, personal website url, portfolio url, website, homepage, domain registration(s), registered domain"),
    ("CUSTOM_TERM", "line", 0.98, REGEX + 15, "EMPLOYMENT", "job title, professional role, designation, employment history, past employer(s), previous role, performance review(s), annual appraisal, evaluation rating, kpi score, professional licen[cs]e(s), medical licen[cs]e, bar number, cpa licen[cs]e"),
    ("CUSTOM_TERM", "line", 0.99, REGEX + 15, "BIOMETRIC", "fingerprint, fingerprint scan, fingerprint data, fingerprint template, fingerprint record, fingerprint id, retina scan, retina scan data, iris scan, facial recognition, facial recognition data, face template, voice recording, voice recording id, voiceprint, voiceprint data, dna profile, genetic profile, str loci, biometric data"),
    ("MEDICAL_RECORD", "line", 0.99, REGEX + 15, "MEDICAL", "medical history, clinical notes, past condition(s), prescription, prescription information, medication, dosage, prescribed drug(s), rx, blood type, blood group, immuni[sz]ation record(s), vaccination record(s), allergy information, allergies, allergic to, anaphylaxis trigger(s), medical diagnosis, medical diagnoses, therapy record(s), psychotherapy note(s), hospital preference(s), blood donor, blood donor information, organ donor, organ donor status, primary doctor"),
    ("LEGAL_REFERENCE", "line", 0.99, REGEX + 15, "LEGAL", "criminal record, conviction history, felony record, civil court record(s), court docket, case number, lawsuit record, litigation detail(s), arrest record(s), booking number, arrest warrant, driving offence(s), traffic violation(s), speeding citation, dui record, property deed(s), parcel number, power of attorney, guardian record(s), support payment record(s), special needs trust(s), public testimony, public testimonies, copyright(s), trademark(s), collector's item(s), census data, social benefits record(s), licen[cs]e(s) issued, public office record(s), child care record(s)"),
    ("CUSTOM_TERM", "line", 0.98, REGEX + 15, "EDUCATION", "academic transcript(s), gpa, cumulative grade, diploma(s) and certificate(s), degree earned, graduation year, standardi[sz]ed test score(s), sat score, act score, gre score, gmat score, mcat score, lsat score, toefl score, ielts score, letter(s) of recommendation"),
    ("IP_ADDRESS", "word", 0.99, REGEX + 10, "IP", "ip address, static ip, client ip"),
    ("IP_ADDRESS", "mac", 0.99, REGEX + 20, "IP", "mac address, hardware address"),
    ("SSN_NATIONAL_ID", "digits", 0.99, REGEX + 20, None, "device imei, device imei number, imei, imei number"),
    ("SSN_NATIONAL_ID", "line", 0.99, REGEX + 15, None, "vehicle registration(s), vin, license plate, license plate number, voter registration, military id, service record(s), service number, veteran status, va file number, security clearance(s), medal(s) and award(s)"),
    ("CUSTOM_TERM", "line", 0.98, REGEX + 15, "ONLINE", "browser history, browsing history, search query, search queries, visited website(s), cookie(s), session cookie, cookie id, browser type and version, user agent, installed app(s), installed application(s), facebook like(s) and reaction(s), tweet(s) and retweet(s), twitter activity, instagram post(s), linkedin connection(s), youtube comment(s), social media activity"),
    ("LOCATION", "line", 0.99, REGEX + 15, "LOCATION", "gps coordinates, geolocation, coordinates, latitude / longitude, latitude/longitude, travel itinerary, travel itineraries, flight plan, travel schedule, location history, check-in(s), checked in at, hotel reservation(s), hotel booking, car rental record(s), wifi network(s), ssid, bssid"),
    ("CUSTOM_TERM", "line", 0.98, REGEX + 15, "POLITICAL", "party membership, political party, registered party, political alignment, political affiliation(s), voting record(s), voter participation, activism record(s), protest attendance, political online post(s), political opinion(s), political belief(s)"),
    ("ORGANIZATION", "line", 0.98, REGEX + 15, "ORGANIZATION", "church or religious group membership, church membership, mosque membership, synagogue, parish, congregation, religious affiliation, union membership, labor union, professional association(s), alumni group(s), sports club membership(s), volunteer membership(s), country club membership(s), youth group(s), seniors group(s), magazine subscription(s), streaming service(s), paid news service(s), saas subscription(s), charity subscription(s)"),
    ("CUSTOMER_ID", "id", 0.98, REGEX + 10, "CUSTOMER", "frequent flyer, frequent flyer number, frequent flyer information, mileage program id"),
    ("CUSTOM_TERM", "line", 0.98, REGEX + 15, "TRAVEL", "flight booking, flight booking record(s), pnr, booking reference, e-ticket, e-ticket number, travel insurance policy, travel insurance policies, insurance policy number"),
    ("CUSTOM_TERM", "line", 0.98, REGEX + 15, "PROFILE", "height, weight, height and weight, eye color, eye colour, hair color, hair colour, tattoo(s) and scar(s), distinguishing mark(s), clothing size(s), shoe size, marital status, genealogy record(s), family tree(s), photo(s) of family, spouse employer, personality test result(s), emotional assessment(s), mood tracking data, sleep tracking data, physical activity log(s), nutrition log(s), stress level measurement(s), sexual orientation, relationship status, dating app profile(s), substance use, rehab record(s), drug test result(s), tobacco use record(s), alcohol purchase record(s), ethnic background, preferred language, religious belief(s), philosophical belief(s), dietary choice(s), ethical or moral stance(s)"),
    ("PERSON_NAME", "line", 0.98, REGEX + 15, "PERSON", "name(s) and age(s) of children, children, children's names, spouse, spouse's name, dependent(s), next of kin, medical emergency contact(s), workplace emergency contact(s), emergency contact, emergency contact name"),
    ("CUSTOM_TERM", "line", 0.98, REGEX + 15, "RECORD", "product review(s) posted, loyalty program membership(s), rewards number, online wish list(s), food delivery order(s), text message(s), email correspondence, call log(s), voicemail(s), social media message(s), research paper(s), unpublished manuscript, letter(s) to the editor, comment(s) on public forums, petition(s) signed, hobby group(s) joined, event ticket(s) purchased, game achievement(s), gamertag, steam id, psn id, music playlist(s), certification(s), professional certificate, accreditation(s), award(s) and honor(s), iq test(s), iq score, skill assessment result(s), food preference(s), language preference(s), video message(s), surveillance footage, competition win(s), scholarship(s), fitness club membership(s), subscription service(s), club membership(s), e-book(s) owned, download history, cloud stored data, chat history, chat histories, forum post(s)"),
    ("SOURCE_CODE_SECRET", "line", 0.98, REGEX + 15, "SECRET", "software code, proprietary algorithm"),
    ("PASSWORD", "secret", 0.99, REGEX + 25, "PASSWORD", "password(s), passphrase, master password, user password, account password, two-factor, two-factor auth, two-factor code, two-factor authentication method(s), 2fa, 2fa code, recovery code(s), backup code(s), otp"),
    ("PASSWORD", "line", 0.99, REGEX + 25, "PASSWORD", "security question, security answer, security question(s) and answer(s), biometric security data"),
)


def spellings(label: str) -> Iterator[str]:
    """``licen[cs]e(s)``: license, licence, licenses, licences."""
    parts = re.split(r"\((s)\)|\[([a-z]+)\]", label)
    yield from ("".join(x) for x in product(*[[p] if i % 3 == 0 else (["", p] if i % 3 == 1 else list(p)) for i, p in enumerate(parts) if p is not None]))


_VALUES = {k: re.compile(v) for k, v in CLASSES.items()}
_RULES = {label: rule for *rule, labels in reversed(LABELS) for entry in labels.split(", ") for label in spellings(entry)}
_LONGEST = max(label.count(" ") + 1 for label in _RULES)
_SEPARATOR = re.compile(r"[:=]|(?<=[ \t])-(?=[ \t])")  # a dash only before account numbers
_LABEL = re.compile(r"[A-Za-z0-9#][^\n:=;|]{0,70}?\Z")
_GAP = re.compile(r"\s*[\"']?")
_BLOCKED = frozenset("bank company org project repo database table service file secret".split())


def labelled(text: str) -> Iterator[tuple]:
    for mark in _SEPARATOR.finditer(text):
        left = text[max(0, mark.start() - 70) : mark.start()]
        words = re.split(r"[\n:=;|,]", left)[-1].lower().replace("’", "'").split()
        for n in range(min(_LONGEST, len(words)), 0, -1):
            rule = _RULES.get(" ".join(words[-n:]).lstrip("\"'([{*-•# ").rstrip("\"'*"))
            if rule is None:
                continue
            kind, values, confidence, priority, prefix = rule
            if mark.group() == "-" and kind != "BANK_ACCOUNT":
                break
            found = _VALUES[values].match(text, _GAP.match(text, mark.end()).end())
            value = found.group().rstrip() if found else ""
            named = kind == "PERSON_NAME" and values == "handle"
            if len(value) < 2 or value.startswith("[[") or named and (value.split()[0].lower() in NO_NAMES or len(words) > n and words[-n - 1] in _BLOCKED):
                break
            if values in ("id", "number", "digits") and not any(c.isdigit() for c in value) and mark.group() == "=":
                break
            yield found.start(), found.start() + len(value), kind, confidence, priority, f"label before a value ({values})", prefix
            break


READER = Reader("context", labelled)
