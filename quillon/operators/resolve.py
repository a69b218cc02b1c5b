"""From overlapping detections to disjoint spans: an ordered greedy choice as one fold, no shuffle and no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.regex import let
from quillon.operators.spans import SPAN, SPANS, empty, overlaps, rebuilt, trimmed

# Detectors whose spans are certain, and priorities (0 where none is given).
CERTIFIED = ("IbanRegex", "RibFrRegex", "EmailRegex", "OrgSingleton", "OrgSingletonLoose", "OrganizationsDenyList", "OrganizationsLooseDenyList", "PeopleDenyList", "PlacesDenyList", "SupplierDenyList")
BY_TAG = {
    "OrgSingleton": 100, "HeaderSourceRegex": 95, "IbanRegex": 96, "RibFrRegex": 96, "RibFrFieldsRegex": 96, "EmailRegex": 95,
    "SupplierDenyList": 95, "VatFrRegex": 92, "SiretRegex": 92, "PlacesDenyList": 92, "OrganizationsDenyList": 90, "PeopleDenyList": 90,
    "FiscalLabeledRegex": 88, "OrgSingletonLoose": 85, "SirenRegex": 80, "PhoneFrRegex": 80, "BicRegex": 60, "PostalCityFrRegex": 75,
    "ZoneFrRegex": 75, "StreetFrRegex": 70, "BpRegex": 75, "PostalCityDeRegex": 75, "StreetDeRegex": 70, "PostfachDeRegex": 75,
    "PostcodeUkRegex": 80, "ZipUsRegex": 70, "PostcodeCaRegex": 80, "StreetEnRegex": 70, "PoBoxRegex": 75, "PostalCityEsRegex": 75,
    "StreetEsRegex": 70, "ApartadoEsRegex": 75, "PostalCityItRegex": 75, "StreetItRegex": 70, "CasellaPostaleItRegex": 75, "PhoneDeRegex": 80,
    "PhoneUkRegex": 80, "PhoneUsRegex": 80, "PhoneOceRegex": 80, "PhoneEsRegex": 80, "PhoneLatamRegex": 80, "PhoneItRegex": 75, "TitleDeRegex": 80,
    "ContextualPersonDeRegex": 75, "TitleEnRegex": 80, "ContextualPersonEnRegex": 75, "TitleEsRegex": 80, "ContextualPersonEsRegex": 75,
    "TitleItRegex": 80, "ContextualPersonItRegex": 75, "CityDict_fr": 65, "CityDict_de": 65, "CityDict_en": 65, "CityDict_es": 65, "CityDict_it": 65,
    "FirstnameDict_fr": 55, "FirstnameDict_de": 55, "FirstnameDict_en": 55, "FirstnameDict_es": 55, "FirstnameDict_it": 55, "FirstnameDict_pt": 55,
    "CityDict_pt": 65, "PostalCityPtRegex": 75, "CepBrRegex": 75, "StreetPtRegex": 70, "ApartadoPtRegex": 75, "PhonePtRegex": 75, "PhoneBrRegex": 75,
    "TitlePtRegex": 80, "ContextualPersonPtRegex": 75, "OrgSuffixRegex": 88, "NameCommaRegex": 75, "InitialSurnameDict": 75, "CiviliteRegex": 75,
    "PrenomNomRegex": 65, "PrenomNomGluedRegex": 40, "ContextualPersonRegex": 75, "StreetGluedRegex": 60, "ContextualLocationRegex": 78,
    "UrlRegex": 50, "GLiNER": 30, "OrderRefByContextRegex": 90, "PlantCodeRegex": 88, "TrackingRegex": 88, "AutomotiveOemDict": 82,
    "ApeCodeRegex": 90, "CapitalRegex": 88, "InternalRefRegex": 85, "PostalEuRegex": 80, "OrgStructureRegex": 75, "CommercialCellRegex": 86,
    "ParenContentRegex": 78, "ClientCodeRegex": 88, "CompactDateRegex": 82, "AddressFragmentRegex": 76, "TableColumnsRegex": 87,
    "AffairNumberRegex": 90,
}


def certified(s: Column) -> Column:
    return s["recognizer"].isin(*CERTIFIED)


def priority(s: Column, by_tag: dict[str, int] | None = None) -> Column:
    table = BY_TAG if by_tag is None else by_tag
    if not table:
        return F.lit(0)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), s["recognizer"]), F.lit(0))


def ordered(spans: Column, by_tag: dict[str, int] | None = None) -> Column:
    """Certain ones first, then the longest, the best score, the highest priority, the leftmost; full ties keep their order."""
    keyed = F.transform(
        spans,
        lambda s, i: F.struct(
            (~certified(s)).alias("a"), (s["start"] - s["end"]).alias("b"), (-s["score"]).alias("c"), (-priority(s, by_tag)).alias("d"), s["start"].alias("e"), i.alias("f"),
            s["end"].alias("end"), s["entity_type"].alias("entity_type"), s["text"].alias("text"), s["recognizer"].alias("recognizer"), F.map_entries(s["metadata"]).alias("metadata"),
        ),
    )
    back = lambda k: F.struct(k["e"].alias("start"), k["end"], k["entity_type"], k["text"], (-k["c"]).alias("score"), k["recognizer"], F.map_from_entries(k["metadata"]).alias("metadata"))
    return F.transform(F.array_sort(keyed), back).cast(SPANS)


def clipped(x: Column, taken: Column) -> Column:
    """The largest part of x outside the certain spans taken so far, the first of equals; its start equals its end if there is none."""
    blocks = F.array_sort(F.transform(F.filter(taken, lambda a: certified(a) & overlaps(a, x)), lambda a: F.struct(a["start"].alias("s"), a["end"].alias("e"))))
    gaps = F.concat(blocks, F.array(F.struct(x["end"].alias("s"), x["end"].alias("e"))))
    state = F.struct(x["start"].alias("at"), x["start"].alias("lo"), x["start"].alias("hi"))

    def step(st: Column, b: Column) -> Column:
        larger = (b["s"] - st["at"]) > (st["hi"] - st["lo"])
        return F.struct(
            F.greatest(st["at"], b["e"]).alias("at"), F.when(larger, st["at"]).otherwise(st["lo"]).alias("lo"), F.when(larger, b["s"]).otherwise(st["hi"]).alias("hi")
        )

    best = F.aggregate(gaps, state, step)
    whole = F.size(blocks) == 0
    cut = lambda g: rebuilt(x, start=g["lo"], end=g["hi"], text=F.substring(x["text"], g["lo"] - x["start"] + 1, g["hi"] - g["lo"]))
    return F.when(whole, x).otherwise(let(best, cut))


def resolve(spans: Column, by_tag: dict[str, int] | None = None) -> Column:
    """Disjoint spans in order of position.

    Spans are trimmed and blank ones dropped; then in order each is clipped around certain spans taken before, and taken unless it overlaps any. The fold is quadratic in the spans
    of one document at worst; equal detections are dropped first.
    """
    clean = F.filter(F.transform(spans, trimmed), lambda s: s["end"] > s["start"])

    def take(done: Column, x: Column) -> Column:
        free = lambda y: (y["end"] > y["start"]) & ~F.exists(done, lambda a: overlaps(a, y))
        return let(clipped(x, done), lambda y: F.when(free(y), F.concat(done, F.array(y.cast(SPAN)))).otherwise(done))

    folded = F.aggregate(ordered(clean, by_tag), empty(), take)
    return F.coalesce(let(folded, lambda f: F.transform(_positions(f), lambda p: F.get(f, p["i"]))), empty())


def _positions(folded: Column) -> Column:
    return F.array_sort(F.transform(folded, lambda s, i: F.struct(s["start"].alias("at"), i.alias("i"))))
