"""Descriptors of the library's resources: fields by type and use, aliases, and what a search returns by default."""

from __future__ import annotations

from ..functions import identifiers, records
from ..model import Field, Resource

FACET = ("facet", "filter")
FILTER = ("filter",)


def _fields(type_: str, paths: str, many: bool = False, uses: tuple[str, ...] = (), shown: str = "", **more) -> list[Field]:
    """Fields of one type, named in one string; those also in ``shown`` are returned by default."""
    return [Field(p, type_, many, uses, shown=p in shown.split(), **more) for p in paths.split()]


# fixed values: field names, types, uses and aliases of each resource
INSTANCE = Resource(
    "instance",
    tuple(
        _fields("keyword", "id tenantId", uses=FACET, shown="id tenantId")
        + _fields("keyword", "hrid source statusId instanceTypeId modeOfIssuanceId", uses=FACET, shown="hrid")
        + _fields("keyword", "statisticalCodeIds instanceFormatIds languages natureOfContentTermIds tags.tagList", True, FACET)
        + _fields("bool", "staffSuppress discoverySuppress isBoundWith shared", uses=FACET, shown="staffSuppress discoverySuppress isBoundWith shared")
        + _fields("multilang", "title indexTitle", uses=("sort",), shown="title")
        + _fields("multilang", "alternativeTitles.alternativeTitle series.value contributors.name subjects.value editions administrativeNotes notes.note", True, shown="contributors.name")
        + _fields("keyword", "alternativeTitles.authorityId series.authorityId contributors.authorityId subjects.authorityId subjects.sourceId subjects.typeId", True, shown="contributors.authorityId")
        + _fields("standard", "publication.publisher publication.place publication.dateOfPublication electronicAccess.linkText electronicAccess.publicNote", True, shown="publication.publisher publication.dateOfPublication")
        + _fields("keyword_icu", "electronicAccess.uri identifiers.value classifications.classificationNumber", True, shown="identifiers.value")
        + _fields("keyword", "identifiers.identifierTypeId classifications.classificationTypeId", True, FILTER, "identifiers.identifierTypeId")
        + _fields("date", "metadata.createdDate metadata.updatedDate", uses=("filter", "sort"))
        + _fields("keyword", "items.id items.effectiveLocationId items.status.name items.materialTypeId items.barcode items.hrid holdings.id holdings.tenantId holdings.sourceId holdings.holdingsTypeId holdings.permanentLocationId holdings.hrid", True, FACET)
        + _fields("bool", "items.discoverySuppress holdings.discoverySuppress", True, FACET)
        + _fields("standard", "items.notes.note items.circulationNotes.note items.electronicAccess.uri items.electronicAccess.linkText items.electronicAccess.publicNote holdings.electronicAccess.uri holdings.electronicAccess.linkText holdings.electronicAccess.publicNote", True)
        + _fields("date", "items.metadata.createdDate items.metadata.updatedDate holdings.metadata.createdDate holdings.metadata.updatedDate", True, FILTER)
        + [Field("sort_title", "keyword_icu", uses=("sort",)), Field("sort_contributors", "keyword_icu", uses=("sort",)), Field("normalizedDate1", "short", uses=("filter", "sort"))]
        + _fields("multilang", "publicNotes itemPublicNotes holdingsPublicNotes uniformTitle allInstances allItems allHoldings", True)
        + [Field("oclc", "standard", True, term=identifiers.oclc_term, plain=False), Field("isbn", "standard", True, term=identifiers.isbn_term), Field("issn", "keyword_no_space_dash", True)]
        + _fields("keyword_icu", "instanceTags itemTags holdingsTags statisticalCodes", True, FACET)
        + _fields("keyword_lowercase", "holdingsTypeId", True, FACET)
        + _fields("keyword_icu", "itemFullCallNumbers holdingsFullCallNumbers holdingsIdentifiers itemIdentifiers", True)
        + _fields("keyword_lowercase", "itemNormalizedCallNumbers holdingsNormalizedCallNumbers", True, term=records.call_number_term)
        + _fields("keyword_icu", "lccn canceledLccn", True, term=identifiers.no_space_term)
        + [Field("normalizedClassificationNumber", "keyword_icu", True, term=records.classification_term), Field("classificationId", "keyword_lowercase", True)]
    ),
    aliases={
        "title": ("title", "alternativeTitles.alternativeTitle", "indexTitle", "series.value"),
        "keyword": ("title", "alternativeTitles.alternativeTitle", "indexTitle", "series.value", "contributors.name"),
        "authorityId": ("alternativeTitles.authorityId", "series.authorityId", "contributors.authorityId", "subjects.authorityId"),
        "series": ("series.value",), "contributors": ("contributors.name",), "subjects": ("subjects.value",), "sourceId": ("subjects.sourceId",), "typeId": ("subjects.typeId",), "publisher": ("publication.publisher",),
        "electronicAccess": ("electronicAccess.uri", "electronicAccess.linkText", "electronicAccess.publicNote"),
        "items.electronicAccess": ("items.electronicAccess.uri", "items.electronicAccess.linkText", "items.electronicAccess.publicNote"),
        "holdings.electronicAccess": ("holdings.electronicAccess.uri", "holdings.electronicAccess.linkText", "holdings.electronicAccess.publicNote"),
        "items.notes.note": ("items.notes.note", "items.circulationNotes.note"),
        "items.effectiveCallNumberComponents": ("itemFullCallNumbers",), "items.fullCallNumber": ("itemFullCallNumbers",), "holdings.fullCallNumber": ("holdingsFullCallNumbers",),
        "items.normalizedCallNumbers": ("itemNormalizedCallNumbers",), "holdings.normalizedCallNumbers": ("holdingsNormalizedCallNumbers",),
        "cql.all": ("allInstances", "allItems", "allHoldings"), "cql.allInstances": ("allInstances",), "cql.allItems": ("allItems",), "cql.allHoldings": ("allHoldings",),
    },
    rename=(("item.", "items."),),
)
AUTHORITY = Resource(
    "authority",
    tuple(
        _fields("keyword", "id tenantId sourceFileId subjectHeadings headingType", uses=(*FACET, "sort"), shown="id tenantId sourceFileId headingType")
        + _fields("keyword", "naturalId", shown="naturalId")
        + [Field("shared", "bool", uses=FACET), Field("isTitleHeadingRef", "bool", uses=FILTER, shown=False), Field("authRefType", "keyword_lowercase", uses=("filter", "sort"), sort=("headingRef",)), Field("headingRef", "keyword_lowercase_folded", uses=("sort",)), Field("headingTermRef", "standard", shown=False)]
        + _fields("date", "metadata.createdDate metadata.updatedDate", uses=FILTER)
        + _fields("keyword_lowercase", "lccn canceledLccn", True, term=identifiers.no_space_term)
    ),
    aliases={"keyword": ("headingTermRef",)},
)
CHILD = _fields("keyword", "instances.tenantId", True, FACET) + _fields("bool", "instances.shared", True, FACET)
SUBJECT = Resource("instance_subject", tuple(_fields("keyword_icu", "value", shown="value", uses=("sort",)) + _fields("keyword", "id authorityId sourceId typeId", uses=FACET, shown="authorityId sourceId typeId") + CHILD))
CONTRIBUTOR = Resource("contributor", tuple(_fields("keyword_icu", "name", shown="name", uses=("sort",)) + _fields("keyword", "id contributorNameTypeId authorityId", uses=FACET, shown="contributorNameTypeId authorityId") + _fields("keyword", "instances.typeId", True, shown="instances.typeId") + CHILD))
CLASSIFICATION = Resource("instance_classification", tuple(_fields("keyword_icu", "number defaultShelvingOrder lcShelvingOrder deweyShelvingOrder", uses=("sort",), shown="number") + _fields("keyword", "id typeId", uses=FILTER, shown="typeId") + CHILD))
CALL_NUMBER = Resource(
    "instance_call_number",
    tuple(
        _fields("keyword_icu", "fullCallNumber defaultShelvingOrder lcShelvingOrder deweyShelvingOrder nlmShelvingOrder sudocShelvingOrder", uses=("sort",), shown="fullCallNumber")
        + _fields("keyword", "id callNumber callNumberPrefix callNumberSuffix", shown="callNumber callNumberPrefix callNumberSuffix")
        + _fields("keyword", "callNumberTypeId", uses=FACET, shown="callNumberTypeId")
        + CHILD
        + _fields("keyword", "instances.locationId", True, FACET)
    ),
    nested="instances",
)
_UNIT = _fields("keyword", "id tenantId name code", uses=("sort",), shown="id tenantId name code") + _fields("date", "metadata.createdDate metadata.updatedDate", uses=FILTER)
LOCATION = Resource("location", tuple(_UNIT + _fields("keyword", "description discoveryDisplayName institutionId campusId libraryId primaryServicePoint", shown="description discoveryDisplayName institutionId campusId libraryId primaryServicePoint") + _fields("bool", "isActive", shown="isActive") + _fields("keyword", "servicePointIds", True, shown="servicePointIds")))
CAMPUS, LIBRARY, INSTITUTION = (Resource(n, tuple(_UNIT)) for n in ("campus", "library", "institution"))
WORK = Resource(
    "linked-data-work",
    tuple(
        _fields("keyword", "id")
        + _fields("keyword", "languages classifications.type instances.id instances.identifiers.value instances.format instances.publications.date", True)
        + _fields("standard", "hubLabels contributors.name notes.value titles.value", True)
        + _fields("bool", "instances.suppress.fromDiscovery instances.suppress.staff", True)
        + _fields("multilang", "contributor note title", True)
        + [Field("isbn", "standard", True, term=identifiers.isbn_term), Field("sort_title", "keyword_lowercase", uses=("sort",))]
        + _fields("standard", "lccn classificationNumber classificationAdditionalNumber", True, term=identifiers.no_space_term)
    ),
    aliases={
        "keyword": ("id", "hubLabels", "instances.id", "instances.identifiers.value", "contributor", "note", "title"),
        "classificationType": ("classifications.type",), "workContributor": ("contributors.name",), "hub": ("hubLabels",), "lang": ("languages",), "language": ("languages",), "workNote": ("notes.value",), "workTitle": ("titles.value",),
        "format": ("instances.format",), "publicationDate": ("instances.publications.date",), "suppressFromDiscovery": ("instances.suppress.fromDiscovery",), "staffSuppress": ("instances.suppress.staff",),
    },
)
HUB = Resource("linked-data-hub", tuple(_fields("keyword", "id originalId") + _fields("standard", "label")), aliases={"keyword": ("id", "originalId", "label")})
LD_AUTHORITY = Resource("linked-data-authority", tuple(_fields("keyword", "id") + _fields("standard", "label") + _fields("standard", "type", True) + _fields("standard", "identifier", True, term=identifiers.no_space_term)), aliases={"keyword": ("id", "label", "type")})
RESOURCES = {r.name: r for r in (INSTANCE, AUTHORITY, SUBJECT, CONTRIBUTOR, CLASSIFICATION, CALL_NUMBER, LOCATION, CAMPUS, LIBRARY, INSTITUTION, WORK, HUB, LD_AUTHORITY)}
