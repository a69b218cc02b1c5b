"""The registry of detectors: what each finds, with which pattern, under which conditions.

A detector is a row of data; `spans_of` turns it into a Catalyst expression over a text column. `needs` are literals, any of which a text must hold (lower-cased)
before its pattern is tried: a cheap test in front of a dear one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import checks
from quillon.functions import word_lists as W
from quillon.functions.needs import literals, needs_digit
from quillon.functions.patterns import PATTERNS
from quillon.functions.regex import after, before, contains_any, digits, let, lines_around, matches, quoted, to_java
from quillon.operators.spans import SPANS, empty, make, overlaps

Keep = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Detector:
    """One pattern of one detector. `group` names the kept part; `keep(text, match)` is the condition on a match."""

    tag: str
    entity: str
    score: float
    pattern: str
    group: str | int | None = None
    keep: Keep | None = None
    needs: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    metadata: dict[str, str] = field(default_factory=dict, hash=False)
    family: str = ""
    build: Callable[[str], Column] | None = None


def _context(name: str, n: int, sides: str = "before") -> Keep:
    """The pattern `name` occurs in the n characters before a match."""
    return lambda t, s: F.regexp_like(before(t, s["start"], n), F.lit(to_java(PATTERNS[name]).pattern))


def _keywords(words: tuple[str, ...], n: int) -> Keep:
    return lambda t, s: contains_any(F.lower(before(t, s["start"], n)), tuple(w.lower() for w in words))


def _first_word_not_in(words: tuple[str, ...], fold: str = "lower", strip: str = "") -> Keep:
    def keep(_: Column, s: Column) -> Column:
        word = F.get(F.split(F.btrim(s["text"]), r"(?U)\s+"), F.lit(0))
        word = F.upper(word) if fold == "upper" else F.lower(word)
        word = F.btrim(word, F.lit(strip)) if strip else word
        return ~word.isin(*words)

    return keep


def _min_digits(n: int, not_in: tuple[str, ...] = ()) -> Keep:
    return lambda _, s: (digits(s["text"]) >= n) & (~F.upper(s["text"]).isin(*not_in) if not_in else F.lit(True))


def _all(*keeps: Keep) -> Keep:
    def keep(t: Column, s: Column) -> Column:
        out = keeps[0](t, s)
        for k in keeps[1:]:
            out = out & k(t, s)
        return out

    return keep


MONEY_WORDS = ("TVA", "VAT", "SIRET", "SIREN", "EUR", "USD")


def _siren_context(t: Column, s: Column) -> Column:
    words = ("SIREN", "RCS", "RC ", "RC.", "B.", "B ", "REGISTRE")
    return contains_any(F.upper(before(t, s["start"], 30)), words) | contains_any(F.upper(after(t, s["end"], 30)), words)


def _distinctive(_: Column, s: Column) -> Column:
    """A capitalised word of four letters, or one of five in capitals, that is no technical acronym."""
    words = F.regexp_extract_all(s["text"], F.lit(r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ0-9\-]+"), F.lit(0))
    capital = lambda w: F.regexp_like(w, F.lit(r"^\p{Lu}")) & (F.length(w) >= F.when(F.upper(w) == w, 5).otherwise(4))
    return F.exists(words, lambda w: capital(w) & ~w.isin(*W.TECHNICAL_ACRONYMS) & ~F.upper(w).isin(*W.TECHNICAL_ACRONYMS))


def _plant_name(_: Column, s: Column) -> Column:
    strip = ".,:-/'’"
    tokens = F.transform(F.split(F.btrim(s["text"]), r"(?U)\s+"), lambda w: F.btrim(F.lower(w), F.lit(strip)))
    named = F.filter(F.slice(tokens, F.lit(2), F.size(tokens)), lambda w: ~w.isin(*W.PLANT_LINKERS))
    return (F.size(named) > 0) & ~F.coalesce(F.get(named, F.lit(0)).isin(*W.PLANT_NOISE), F.lit(False))


def _incoterm_place(t: Column, s: Column) -> Column:
    short = (F.length(s["text"]) <= 3) & (F.upper(s["text"]) == s["text"]) & (F.lower(s["text"]) != s["text"])
    return _first_word_not_in(W.INCOTERM_NOT_LOCATION)(t, s) & ~short


#: A confirmation's own labels, which such a document does not mask.
OWN_LABEL = (
    r"(?iuU)\s*(?:AR(?:\s*N[°o]\.?)?|Accus[ée]\s+(?:de\s+)?r[ée]ception(?:\s*N[°o]\.?)?|SC(?:\s*N[°o]\.?)?|CC(?:\s*N[°o]\.?)?"
    r"|Confirmation\s+(?:de\s+)?commande(?:\s*N[°o]\.?)?|Auftragsbest[äa]tigung(?:\s*Nr\.?)?|Confirmaci[óo]n\s+pedido)\s*[:.\-/#]?\s*$"
)


def is_confirmation(text: Column) -> Column:
    """Whether a text announces itself as an order confirmation in its first 2000 characters."""
    return F.regexp_like(F.substring(text, 1, 2000), F.lit(to_java(PATTERNS["confirmation_header"]).pattern))


def _not_own_label(t: Column, s: Column) -> Column:
    """In a confirmation, the label right before the value is not one of its own."""
    label = F.regexp_replace(before(t, s["start"], 60), r"(?U)\s+$", "")
    last_line = F.substring_index(label, "\n", -1)
    return ~is_confirmation(t) | ~F.regexp_like(last_line, F.lit(OWN_LABEL.replace(r"(?iuU)\s*", r"(?iuU)(?:^|\W)", 1)))


def _ibans(name: str) -> Column:
    """Starts by country and two digits, then as many letters and digits as the country has, by checksum or by a bank word before."""
    text = F.col(name)

    def judged(m: Column) -> Column:
        n = checks.iban_length(F.substring(m["text"], 1, 2))
        got = F.when(n.isNotNull(), checks.collected(text, m["start"], n)).otherwise(F.lit(""))
        return let(
            got,
            lambda g: F.struct(
                m["start"].alias("start"), (m["start"] + F.length(g)).cast("int").alias("end"), g.alias("text"),
                F.when(g == "", F.lit(0.0)).when(checks.iban_valid(g), F.lit(0.85)).when(contains_any(F.upper(before(text, m["start"], 30)), W.IBAN_CONTEXT), F.lit(0.7)).otherwise(F.lit(0.0)).alias("score"),
            ),
        )

    found = F.filter(F.transform(matches(name, PATTERNS["iban_start"]), judged), lambda x: x["score"] > 0)
    return F.transform(found, lambda x: make(x, "IBAN", "IbanRegex", x["score"]))


def _bics(name: str) -> Column:
    """By a bank word nearby, or right after an IBAN."""
    text = F.col(name)

    def judged(m: Column, ibans: Column) -> Column:
        word = (
            contains_any(F.upper(before(text, m["start"], 30)), W.BIC_CONTEXT) | contains_any(F.upper(after(text, m["end"], 30)), W.BIC_CONTEXT)
            | F.startswith(m["text"], F.lit("BIC")) | F.startswith(m["text"], F.lit("SWIFT"))
        )
        near = F.exists(ibans, lambda i: (m["start"] - i["end"]).between(0, 5))
        score = F.when(m["text"].isin(*W.BIC_NOISE), F.lit(0.0)).when(word, F.lit(0.7)).when(near, F.lit(0.6)).otherwise(F.lit(0.0))
        return make(m, "BIC", "BicRegex", score)

    return let(_ibans(name), lambda ibans: F.filter(F.transform(matches(name, PATTERNS["bic"]), lambda m: judged(m, ibans)), lambda s: s["score"] > 0))


def _ribs(name: str) -> Column:
    """After the label, past at most 30 characters of a bank's name; or by its structure anywhere. Both by key, one span per place."""
    text = F.col(name)

    def labelled(m: Column) -> Column:
        rest = F.substring(text, m["end"] + 1, F.lit(90))
        skipped = F.length(F.regexp_extract(rest, r"^([A-Za-z \t\r\n:#\-./]{0,30})", 1))
        got = F.regexp_extract(F.substring(rest, skipped + 1, F.lit(90)), r"^([0-9A-Za-z](?:[ \t\r\n:#\-./]*[A-Za-z0-9]){22})", 1)
        return F.struct((m["end"] + skipped).cast("int").alias("start"), (m["end"] + skipped + F.length(got)).cast("int").alias("end"), got.alias("text"))

    one = F.transform(F.filter(F.transform(matches(name, PATTERNS["rib_label"]), labelled), lambda x: checks.rib_valid(x["text"])), lambda x: make(x, "RIB", "RibFrRegex", 0.85))
    two = F.transform(F.filter(matches(name, PATTERNS["rib_structured"], "rib"), lambda x: checks.rib_valid(x["text"])), lambda x: make(x, "RIB", "RibFrRegex", 0.85 * 1.1))
    return let(one, lambda a: F.concat(a, F.filter(two, lambda x: ~F.exists(a, lambda y: (y["start"] == x["start"]) & (y["end"] == x["end"])))))


def _site_pattern(language: str) -> str:
    """Site keyword, a preposition or none, then one to three capitalised words."""
    spec = W.SITE_KEYWORDS[language]
    word = lambda k: f"(?i:{re.escape(k)})"
    glued = [word(p) for p in spec["prepositions"] if p.endswith("'")]
    apart = [word(p) for p in spec["prepositions"] if not p.endswith("'")]
    links = [rf"\s+(?:{'|'.join(apart)})\s+"] * bool(apart) + [rf"\s+(?:{'|'.join(glued)})"] * bool(glued) + [r"\s+"]
    name = r"[A-Z][A-Za-zéèêëàâäîïôöùûüçÄÖÜß'\-]{2,30}"
    return rf"\b(?:{'|'.join(map(word, spec['keywords']))})\b(?:{'|'.join(links)})(?P<value>{name}(?:[\s\-]{name}){{0,2}})"


def _org_suffix_pattern() -> str:
    suffixes = "|".join(map(re.escape, sorted(W.LEGAL_SUFFIXES, key=len, reverse=True)))
    return rf"\b{W.NAME_PART}(?:[ \t\-]+{W.NAME_PART}){{0,3}}[ \t]+(?i:{suffixes})\b"


EXTRA = {f"site_{k}": _site_pattern(k) for k in W.SITE_KEYWORDS} | {"org_suffix": _org_suffix_pattern()}


def pattern_of(name: str) -> str:
    return PATTERNS.get(name) or EXTRA[name]


def _rows(family: str, entity: str, rows: list[tuple], languages: tuple[str, ...] = ()) -> list[Detector]:
    """(tag, score, pattern, group, keep, needs) to detectors of one family."""
    out = []
    for row in rows:
        tag, score, pattern, group, keep, needs, *meta = (*row, *(None,) * 6)[: max(6, len(row))]
        out.append(Detector(tag, entity, score, pattern, group, keep, needs or (), languages, meta[0] if meta and meta[0] else {}, family))
    return out


def _national(tag: str, pattern: str, score: float = 0.9, keep: Keep | None = None, group: str | None = "value", needs: tuple[str, ...] = ()) -> Detector:
    return Detector(tag, "NATIONAL_ID", score, pattern, group, keep, needs, (), {}, "national_id")


#: In the order in which ties between equal spans are decided.
UNIVERSAL: list[Detector] = [
    *_rows("contact", "EMAIL", [("EmailRegex", 0.95, "email", None, None, ("@",))]),
    *_rows("contact", "URL", [("UrlRegex", 0.7, "url", None, None, (".",))]),
    Detector("IbanRegex", "IBAN", 0.85, "iban_start", family="bank.account", build=_ibans),
    Detector("BicRegex", "BIC", 0.7, "bic", family="bank.account", build=_bics),
    *_rows("place", "LOCATION", [("HeaderSourceRegex", 0.95, "header_source", 1, None, ("fichier",))]),
    *_rows("fiscal", "VAT", [("FiscalLabeledRegex", 0.9, "fiscal_labelled", 1)]),
    Detector("RibFrRegex", "RIB", 0.85, "rib_label", family="bank.account", build=_ribs),
    *_rows("bank.context", "RIB", [("RibFrFieldsRegex", 0.9, "rib_field", 1, None, ("banque", "guichet", "compte", "rib"))]),
    *_rows("person.birth", "DATE_OF_BIRTH", [("DateOfBirthRegex", 0.9, "birth_date", "dmy|ymd|cjk"), ("DateOfBirthRegex", 0.9, "birth_date_before", "dmy")]),
    _national("NationalIdRegex", "national_id", 0.85, _min_digits(1), "id"),
    _national("SocialSecurityFrRegex", "socsec_fr", 0.95, _context("socsec_fr_context", 60)),
    _national("UrssafRegex", "urssaf", needs=("urssaf",)),
    _national("UkNiNumberRegex", "uk_ni", 0.9, _context("uk_ni_context", 60)),
    _national("UkDrivingLicenceRegex", "uk_driver", 0.85, _min_digits(1), needs=("licence", "license")),
    _national("UkUtrRegex", "uk_utr"),
    _national("HmrcRefRegex", "hmrc", group=None, needs=("hmrc",)),
    _national("EsDniRegex", "es_dni", 0.9, _context("es_id_context", 40)),
    _national("EsNieRegex", "es_nie"),
    _national("EsCifRegex", "es_cif", 0.9, lambda t, s: F.regexp_like(before(t, s["start"], 40), F.lit(r"(?iu)C\.?I\.?F\.?|N\.?I\.?F\.?"))),
    _national("EsCccRegex", "es_ccc"),
    _national("PtNifRegex", "pt_nif", 0.9, _context("pt_nif_context", 30)),
    _national("PtCcRegex", "pt_cc"),
    _national("PtNissRegex", "pt_niss"),
    _national("PlNipRegex", "pl_nip", 0.95, needs=("nip",)),
    _national("PlRegonRegex", "pl_regon", needs=("regon",)),
    _national("PlKrsRegex", "pl_krs", needs=("krs",)),
    _national("PlPeselRegex", "pl_pesel", 0.95, needs=("pesel",)),
    _national("DeHandelsregisterRegex", "de_hr", needs=("hr",)),
    _national("DeNationalIdRegex", "de_id", 0.9, _min_digits(6)),
    _national("TrTcknRegex", "tr_tckn", 0.95),
    _national("TrVknRegex", "tr_vkn"),
    _national("TrSgkRegex", "tr_sgk"),
    _national("TrSicilRegex", "tr_sicil", 0.85),
    _national("CzRodneCisloRegex", "cz_rc", 0.95),
    _national("CzIcoRegex", "cz_ico"),
    _national("CzDicRegex", "cz_dic"),
    _national("CzOpRegex", "cz_op", 0.85, _min_digits(1)),
    _national("CzCsszRegex", "cz_cssz"),
    _national("CnIdRegex", "cn_id", 0.95),
    _national("CnUsccRegex", "cn_uscc"),
    # the published alternative that matches a lone letter is left out: a value must hold a digit
    _national("CnHkidRegex", "cn_hkid", 0.85, _min_digits(1)),
    _national("CnPassportRegex", "cn_passport"),
    _national("BankAccountByContextRegex", "bank_account", 0.85, _min_digits(8)),
    _national("JpMaiNumberRegex", "jp_number", 0.95),
    _national("JpHojinBangoRegex", "jp_corporate"),
    _national("JpDriverLicenceRegex", "jp_licence"),
    _national("JpPassportRegex", "jp_passport"),
    _national("JpHealthInsuranceRegex", "jp_health"),
    _national("JpToukiBangouRegex", "jp_registry"),
    _national("KrBusinessRegistrationRegex", "kr_business"),
    _national("KrRrnRegex", "kr_rrn", 0.95),
    _national("ItCodiceFiscaleRegex", "it_cf", 0.95),
    _national("ItCodiceSdiRegex", "it_sdi"),
    _national("ItRegulatoryRegex", "it_regulatory"),
    _national("ItTesseraSanitariaRegex", "it_tessera"),
    _national("BgEgnRegex", "bg_egn", 0.95),
    _national("BgEikRegex", "bg_eik"),
    _national("BgLnchRegex", "bg_lnch", 0.95),
    _national("BgIdCardRegex", "bg_id_card"),
    _national("BgHealthInsuranceRegex", "bg_health"),
    *_rows("phone", "PHONE", [
        ("PhoneBeRegex", 0.85, "phone_be", None, None, ("32",)),
        ("PhoneUkRegex", 0.85, "phone_uk", None, None, ("44",)),
        ("PhoneOceRegex", 0.85, "phone_oce", None, None, ("+",)),
        ("PhoneInternationalRegex", 0.85, "phone_international", None, None, ("+",)),
    ]),
    *_rows("person.name", "PERSON", [
        ("MaidenNameRegex", 0.85, "maiden_fr", "name", _first_word_not_in(W.MAIDEN_STOPS)),
        ("MaidenNameRegex", 0.85, "maiden_other", "name", _first_word_not_in(W.MAIDEN_STOPS)),
    ]),
    *_rows("bank.context", "ORGANIZATION", [
        ("BankByContextRegex", 0.8, "bank_label", "bank", _first_word_not_in(W.BANK_STOPS)),
        ("BankByContextRegex", 0.7, "bank_inline", "bank", _first_word_not_in(W.BANK_INLINE_STOPS)),
        ("BankByContextRegex", 0.7, "bank_inline_cjk", "bank"),
    ]),
    *_rows("organisation", "ORGANIZATION", [("CompanyHeaderRegex", 0.85, "company_header", "acr", lambda _, s: ~s["text"].isin(*W.HEADER_ACRONYMS))]),
    *_rows("place", "LOCATION", [("PlantCodeRegex", 0.85, "plant", None, _plant_name)]),
    *[
        d for name, carrier in (("dhl", "DHL"), ("ups", "UPS"), ("chronopost", "Chronopost/Colissimo"), ("fedex", "FedEx"), ("gls", "GLS"), ("dpd", "DPD"), ("tnt", "TNT"), ("schenker", "Schenker"))
        for d in _rows("reference.number", "TRACKING", [("TrackingRegex", 0.9, f"tracking_{name}", "v", None, (), {"carrier": carrier})])
    ],
    *_rows("reference.number", "TRACKING", [("TrackingRegex", 0.9 * 0.95, "tracking_labelled", "v", _min_digits(4))]),
    *_rows("fiscal", "APE_CODE", [
        ("ApeCodeRegex", 0.92, "ape", "value"),
        ("ApeCodeRegex", 0.92 * 0.9, "ape_orphan", "value", lambda t, s: F.regexp_like(lines_around(t, s["start"], 3), F.lit(to_java(PATTERNS["ape_context"]).pattern))),
    ]),
    *_rows("fiscal", "CAPITAL", [("CapitalRegex", 0.9, "capital", "value", _min_digits(4))]),
    *_rows("fiscal", "VAT", [("WeeeRegex", 0.92, "weee", "value")]),
    *_rows("reference.own", "INTERNAL_REF", [("InternalRefRegex", 0.88, "internal_ref", "value", _all(_min_digits(1), _not_own_label))]),
    *[d for k in ("pt", "uk", "pl", "nl", "cz") for d in _rows("address", "LOCATION", [("PostalEuRegex", 0.85, f"postal_eu_{k}", "v", None, (), {"country": k.upper()})])],
    *_rows("organisation", "ORG_STRUCTURE", [("OrgStructureRegex", 0.78, "org_structure", "value")]),
    *_rows("person.name", "PERSON", [("CommercialCellRegex", 0.85, "commercial_cell", "value", _first_word_not_in(W.CELL_NOT_A_NAME, "upper", ".,;:-_'"))]),
    *_rows("organisation", "COMMENT", [("ParenContentRegex", 0.8, "paren", None, _distinctive, ("(",))]),
    *_rows("reference.client", "CLIENT_CODE", [("ClientCodeRegex", 0.88, "client_code", "value", _min_digits(3, MONEY_WORDS))]),
    *_rows("place", "LOCATION", [
        ("AddressFragmentRegex", 0.78 * 0.95, "toponym_cardinal", "value", _first_word_not_in(("notre", "votre", "leur", "bureau", "agence", "service", "departement", "direction"))),
    ]),
    *_rows("reference.number", "AFFAIR_NUMBER", [("AffairNumberRegex", 0.88, "affair", "value", _min_digits(2, (*MONEY_WORDS, "JOUR", "JOURS", "SEM", "JANV", "FEV", "AVR")))]),
    *_rows("organisation", "ORGANIZATION", [("OrgSuffixRegex", 0.85, "org_suffix")]),
]

ADDRESS: list[Detector] = [
    *_rows("address", "LOCATION", [
        ("PostalCityFrRegex", 0.85, "postal_city_fr", None, lambda _, s: ~F.arrays_overlap(F.split(F.lower(s["text"]), r"[ \t\-']+"), F.array(*map(F.lit, W.POSTAL_CITY_STOPS)))),
        ("PostalCodeIsolatedFrRegex", 0.8, "postal_code_fr", "cp", lambda t, s: (s["text"] != "00000") & F.regexp_like(lines_around(t, s["start"], 3, False), F.lit(to_java(PATTERNS["address_context"]).pattern))),
        ("ZoneFrRegex", 0.85, "zone_fr"), ("StreetFrRegex", 0.85, "street_fr"), ("StreetFrRegex", 0.8, "street_fr_bare"), ("StreetGluedRegex", 0.8, "street_fr_glued"), ("BpRegex", 0.85, "bp"),
    ], ("fr",)),
    *_rows("address", "LOCATION", [("PostalCityDeRegex", 0.85, "postal_city_de"), ("StreetDeRegex", 0.85, "street_de"), ("PostfachDeRegex", 0.85, "postfach_de", None, None, ("postfach",)), ("ZoneDeRegex", 0.85, "zone_de"), ("BuildingDeRegex", 0.85, "building_de")], ("de",)),
    *_rows("address", "LOCATION", [("PostcodeUkRegex", 0.85, "postcode_uk"), ("ZipUsRegex", 0.85, "zip_us"), ("PostcodeCaRegex", 0.85, "postcode_ca"), ("StreetEnRegex", 0.85, "street_en"), ("PoBoxRegex", 0.85, "po_box"), ("ZoneEnRegex", 0.85, "zone_en"), ("BuildingEnRegex", 0.85, "building_en")], ("en",)),
    *_rows("address", "LOCATION", [("PostalCityEsRegex", 0.85, "postal_city_es"), ("StreetEsRegex", 0.85, "street_es"), ("ApartadoEsRegex", 0.85, "apartado_es"), ("ZoneEsRegex", 0.85, "zone_es"), ("BuildingEsRegex", 0.85, "building_es")], ("es",)),
    *_rows("address", "LOCATION", [("PostalCityItRegex", 0.85, "postal_city_it"), ("StreetItRegex", 0.85, "street_it"), ("CasellaPostaleItRegex", 0.85, "casella_postale_it"), ("ZoneItRegex", 0.85, "zone_it"), ("BuildingItRegex", 0.85, "building_it")], ("it",)),
    *_rows("address", "LOCATION", [("PostalCityPtRegex", 0.85, "postal_city_pt"), ("CepBrRegex", 0.85, "cep_br"), ("StreetPtRegex", 0.85, "street_pt"), ("ApartadoPtRegex", 0.85, "apartado_pt"), ("ZonePtRegex", 0.85, "zone_pt"), ("BuildingPtRegex", 0.85, "building_pt")], ("pt",)),
    *_rows("address", "LOCATION", [("PostalCityBgRegex", 0.85, "postal_city_bg"), ("StreetBgRegex", 0.85, "street_bg"), ("ApartmentBgRegex", 0.85, "apartment_bg")], ("bg",)),
]

PHONE: list[Detector] = [
    *_rows("phone", "PHONE", [
        ("PhoneFrRegex", 0.85, "phone_fr", None, lambda _, s: ~F.regexp_like(s["text"], F.lit(r"^\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}$"))),
        ("PhoneFrRegex", 0.85 * 0.95, "phone_fr_labelled", "value"),
    ], ("fr",)),
    *_rows("phone", "PHONE", [("PhoneDeRegex", 0.8, "phone_de")], ("de",)),
    *_rows("phone", "PHONE", [("PhoneUkRegex", 0.8, "phone_uk"), ("PhoneUsRegex", 0.8, "phone_us"), ("PhoneOceRegex", 0.8, "phone_oce")], ("en",)),
    *_rows("phone", "PHONE", [("PhoneEsRegex", 0.8, "phone_es"), ("PhoneLatamRegex", 0.8, "phone_latam")], ("es",)),
    *_rows("phone", "PHONE", [("PhoneItRegex", 0.75, "phone_it")], ("it",)),
    *_rows("phone", "PHONE", [("PhonePtRegex", 0.75, "phone_pt"), ("PhoneBrRegex", 0.75, "phone_br")], ("pt",)),
]

NAMES: list[Detector] = [
    *_rows("person.name", "PERSON", [("NameCommaRegex", 0.8, "name_comma"), ("CiviliteRegex", 0.85, "civilite"), ("PrenomNomRegex", 0.75, "prenom_nom"), ("ContextualPersonRegex", 0.75, "bigram_fr", None, _keywords(W.PERSON_KEYWORDS_FR, 40))], ("fr",)),
    *_rows("person.name", "PERSON", [("TitleDeRegex", 0.85, "title_de")], ("de",)),
    *[
        d for k, words in (("en", W.PERSON_KEYWORDS_EN), ("es", W.PERSON_KEYWORDS_ES), ("it", W.PERSON_KEYWORDS_IT), ("pt", W.PERSON_KEYWORDS_PT), ("bg", W.PERSON_KEYWORDS_BG))
        for d in _rows("person.name", "PERSON", [(f"Title{k.title()}Regex", 0.85, f"title_{k}"), (f"ContextualPerson{k.title()}Regex", 0.75, f"bigram_{k}", None, _keywords(words, 40))], (k,))
    ],
]

FISCAL_FR: list[Detector] = [
    *_rows("fiscal", "SIRET", [("SiretRegex", 0.9, "siret")], ("fr",)),
    *_rows("fiscal", "SIREN", [("SirenRegex", 0.7, "siren", None, _siren_context)], ("fr",)),
    *_rows("fiscal", "VAT", [("VatFrRegex", 0.95, "vat_fr")], ("fr",)),
]

INCOTERM = _rows("place", "LOCATION", [("IncotermLocationRegex", 0.85, "incoterm", "location", _incoterm_place)])
SITES = [d for k in W.SITE_KEYWORDS for d in _rows("place", "LOCATION", [("ContextualLocationRegex", 0.7, f"site_{k}", "value")], (k,))]
#: Defined, but not part of detection unless asked for.
OPTIONAL = [
    *_rows("reference.number", "DATE", [("CompactDateRegex", 0.85, "compact_date", 1 if "(?P<" not in PATTERNS["compact_date"] else re.search(r"\(\?P<(\w+)>", PATTERNS["compact_date"])[1])]),
    *_rows("person.name", "PERSON", [("PrenomNomGluedRegex", 0.55, "prenom_nom_glued")]),
]
ALL = [*UNIVERSAL, *ADDRESS, *PHONE, *NAMES, *INCOTERM, *FISCAL_FR, *SITES]


#: Columns that detection adds to a row and drops again: the lower-cased text and whether it holds a digit.
LOWER, DIGIT = "__lower", "__digit"


def prepared(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows with what detectors test before their patterns."""
    t = F.coalesce(F.col(text), F.lit(""))
    # the long s has no other lower case, yet patterns without case take it for an s
    return docs.withColumns({LOWER: F.replace(F.lower(t), F.lit("ſ"), F.lit("s")), DIGIT: F.regexp_like(t, F.lit(r"\p{Nd}"))})


def in_families(d: Detector, families: tuple[str, ...]) -> bool:
    """Whether a detector's family, or the whole that it is a part of ("bank" of "bank.account"), is among them; without families, always."""
    return not families or d.family in families or d.family.partition(".")[0] in families


def spans_of(d: Detector, text: str = "text", languages: Column | None = None) -> Column:
    """The spans of one detector over the named column of prepared rows, as an array in order of position."""
    source, column = pattern_of(d.pattern), F.col(text)
    if d.build:
        found = d.build(text)
    else:
        hits = matches(text, source, d.group, d.family == "organisation")
        if d.keep:
            hits = F.filter(hits, lambda m: d.keep(column, m))
        meta = ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in d.metadata.items())
        found = F.transform(hits, lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), F.lit(d.entity).alias("entity_type"), m["text"].alias("text"), F.lit(float(d.score)).alias("score"), F.lit(d.tag).alias("recognizer"),
            F.expr(f"CAST(map({meta}) AS map<string,string>)").alias("metadata"),
        ))
    needed, tests = d.needs or (() if d.build else literals(source)), []
    if languages is not None and d.languages:
        tests.append(f"array_contains(languages, '{d.languages[0]}')")
    if needed:
        tests.append("(" + " OR ".join(f"contains({LOWER}, {quoted(n)})" for n in needed) + ")")
    if d.entity in ("IBAN", "RIB") or needs_digit(source):
        tests.append(DIGIT)
    return F.when(F.expr(" AND ".join(tests)), F.coalesce(found, empty())).otherwise(empty()) if tests else F.coalesce(found, empty())


def distinct_places(spans: Column) -> Column:
    """Of spans of one detector at one place, the first."""
    return F.filter(spans, lambda s, i: ~F.exists(F.slice(spans, F.lit(1), i), lambda o: (o["start"] == s["start"]) & (o["end"] == s["end"]) & (o["recognizer"] == s["recognizer"])))


__all__ = ["ALL", "Detector", "OPTIONAL", "SPANS", "UNIVERSAL", "distinct_places", "is_confirmation", "overlaps", "pattern_of", "spans_of"]
