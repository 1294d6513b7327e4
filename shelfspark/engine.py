"""The engine: stored resources behind one object, as a service's end points would use them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cql.bind import And, filter_field, terms_of, to_column
from .cql.parser import Boolean, parse
from .errors import NotFoundError, QueryError, ValidationError
from .functions import stemming
from .model import Resource
from .operators import browse as browsing
from .operators import consortium, facets, search
from .operators.ids import extracted
from .plans import index
from .plans.ordered import Ordered
from .plans.library import RESOURCES

MOST_LANGUAGES = 5
LANGUAGES = ("ara", "ger", "eng", "spa", "fre", "heb", "ita", "jpn", "kor", "rus", "swe", "chi")
#: What each browse goes through: resource, target field of the query, further sort keys, column named in cursors.
BROWSES = {
    "subjects": ("instance_subject", "value", ("authorityId", "sourceId", "typeId", "id"), "value"),
    "contributors": ("contributor", "name", ("authorityId", "contributorNameTypeId", "id"), "name"),
    "authorities": ("authority", "headingRef", ("id",), "headingRef"),
    "call-numbers": ("instance_call_number", "fullCallNumber", ("id",), "fullCallNumber"),
    "classifications": ("instance_classification", "number", ("id",), "number"),
}
#: Filters of a browse that choose elements of a child resource's ``instances``.
ELEMENT_FILTERS = {"instances.shared": "shared", "instances.tenantId": "tenants", "instances.locationId": "location"}


@dataclass
class Engine:
    """``tables``: a DataFrame for each resource name, or a function that reads it.  ``tenant``: who asks."""

    spark: SparkSession
    tables: dict[str, DataFrame | Callable[[], DataFrame]]
    tenant: consortium.Tenant = consortium.Tenant("local")
    resources: dict[str, Resource] = field(default_factory=lambda: dict(RESOURCES))
    configs: browsing.Configs = field(default_factory=browsing.Configs)
    languages: tuple[str, ...] = ("eng",)
    inverted: dict[str, index.Inverted] = field(default_factory=dict)
    grams: dict[str, index.Grams] = field(default_factory=dict)
    ordered: dict[tuple[str, str | None], Ordered] = field(default_factory=dict)
    features: dict[str, bool] = field(default_factory=lambda: {"search.all.fields": False})

    def resource(self, name: str) -> Resource:
        if name not in self.resources or name not in self.tables:
            raise NotFoundError(f"Resource {name} does not exist")
        found = self.resources[name]
        return replace(found, languages=self.spoken()) if found.language_path in self.table(name).columns else found

    def spoken(self) -> tuple[str, ...]:
        """Configured languages that have an analyser of their own here."""
        return tuple(x for x in self.languages if x in stemming.LANGUAGES)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise NotFoundError(f"Resource {name} does not exist")
        found = self.tables[name]
        return found() if callable(found) else found

    def visible(self, name: str, consolidated: bool = False) -> DataFrame:
        """Documents of a resource that the tenant may see."""
        return self.table(name) if consolidated else self._seen(name, self.table(name))

    def _seen(self, name: str, df: DataFrame) -> DataFrame:
        if not {"tenantId", "shared"} <= set(df.columns):
            return df
        condition = consortium.visible(self.tenant, F.col("tenantId"), F.col("shared"), name.startswith("linked-data"))
        return df if condition is None else df.where(condition)

    def _allowed(self, cql: str) -> str:
        """A query over ``cql.all`` needs the feature; the string may stand in a term."""

        def names(node) -> set[str]:
            return names(node.left) | names(node.right) if isinstance(node, Boolean) else {node.index}

        if "cql.all" in cql and not self.features.get("search.all.fields") and any(n == "cql.all" or n.startswith("cql.all.") for n in names(parse(cql).root)):
            raise QueryError("Invalid search field provided in the CQL query")
        return cql

    def search(self, name: str, cql: str, limit: int | None = 100, offset: int = 0, include: list[str] | None = None, expand_all: bool = False, consolidated: bool = False) -> DataFrame:
        return search.search(self.visible(name, consolidated), self._allowed(cql), self.resource(name), limit, offset, include, expand_all, inverted=self.inverted.get(name), grams=self.grams.get(name))

    def total(self, name: str, cql: str) -> int:
        return search.total(self.visible(name), self._allowed(cql), self.resource(name))

    def facets(self, name: str, cql: str, specs: list[str]) -> DataFrame:
        return facets.facets(self.visible(name), self._allowed(cql), specs, self.resource(name))

    def facet_totals(self, name: str, cql: str, specs: list[str]) -> DataFrame:
        return facets.totals(self.facets(name, cql, specs), specs, self.resource(name))

    def holdings(self, **filters) -> DataFrame:
        return consortium.holdings(self.table("holdings"), **filters)

    def items(self, **filters) -> DataFrame:
        return consortium.items(self.table("item"), **filters)

    def locations(self, **filters) -> DataFrame:
        return self.units("location", **filters)

    def units(self, kind: str, **filters) -> DataFrame:
        """A page of the consortium's institutions, campuses, libraries or locations."""
        if kind not in ("institution", "campus", "library", "location"):
            raise NotFoundError(f"Location unit {kind} does not exist")
        return consortium.locations(self.visible(kind), **filters)

    def batch(self, kind: str, identifier: str, values: list[str]) -> DataFrame:
        return consortium.batch(self.table(kind), identifier, values)

    def ids(self, name: str, cql: str, path: str = "id") -> DataFrame:
        return extracted(self.visible(name), cql, self.resource(name), path)

    def browse(self, kind: str, cql: str, limit: int = 100, preceding: int | None = None, highlight: bool = True, option: str | None = None) -> DataFrame:
        """A page of a browse; call numbers and classifications take an option, whose configuration names the order and the types."""
        if kind not in BROWSES:
            raise NotFoundError(f"Browse {kind} does not exist")
        resource, order, algorithm, types = self._browse_order(kind, option)
        ctx = browsing.context(cql, resource, BROWSES[kind][1], limit, preceding)
        anchor = None
        if algorithm is not None:
            key = self.spark.range(1).select(browsing.shelving_key(F.lit(ctx.anchor), algorithm).alias("k")).first()["k"]
            anchor = (key or ctx.anchor).lower()

        def left(df: DataFrame) -> DataFrame:
            df, rest = self._browsed(resource.name, df, ctx.filters)
            if types:
                df = df.where(F.col("callNumberTypeId" if kind == "call-numbers" else "typeId").isin(*types))
            if kind == "authorities":
                df = df.where(F.col("authRefType").isin("Authorized", "Reference"))
            return df.where(to_column(And(tuple(rest)), resource, df.columns)) if rest else df

        stored = self.ordered.get((kind, option))
        if stored is None:
            df = self.table(resource.name)
            df = browsing.shelved(df, BROWSES[kind][1], algorithm) if algorithm is not None else df
        else:
            narrowed = ctx.filters or types or kind == "authorities" or self.tenant.central is not None
            df = stored.near(ctx, browsing.anchor_key_of(ctx, order, resource) if anchor is None else anchor, resource, left if narrowed else None)
        df = left(df)
        keep = tuple(k for k in order.keys if k in df.columns)
        return browsing.browse(df, replace(ctx, filters=()), browsing.Order(keep, order.name), resource, anchor, highlight)

    def _browse_order(self, kind: str, option: str | None) -> tuple[Resource, browsing.Order, str | None, tuple[str, ...]]:
        """(resource, order, algorithm of the shelving key, type ids) of a browse."""
        name, target, rest, shown = BROWSES[kind]
        if option is None:
            return self.resource(name), browsing.Order((target, *rest), shown), None, ()
        algorithm, types = self.configs.get("instance-call-number" if kind == "call-numbers" else "instance-classification", option)
        return self.resource(name), browsing.Order(("shelving_order", target, *rest), shown), algorithm, tuple(types)

    def store_ordered(self, kind: str, path: str, option: str | None = None, parts: int | None = None) -> None:
        """Write what a browse goes through in its order, shelving keys included; pages read the files around their anchors from there on."""
        resource, order, algorithm, _ = self._browse_order(kind, option)
        df = self.table(resource.name)
        df = browsing.shelved(df, BROWSES[kind][1], algorithm) if algorithm is not None else df
        order = browsing.Order(tuple(k for k in order.keys if k in df.columns), order.name)
        self.ordered[kind, option] = Ordered.write(df, resource, path, order, parts)

    def _browsed(self, name: str, df: DataFrame, filters: tuple) -> tuple[DataFrame, list]:
        """(what the tenant may browse, filters still to apply): documents it sees; of child resources those with an element that it sees and the filters ask for."""
        if "instances" not in df.columns:
            return self._seen(name, df), list(filters)
        wanted, rest = {}, []
        for f in filters:
            path = filter_field(f)
            values = terms_of(f) if path in ELEMENT_FILTERS else []
            wanted.update({ELEMENT_FILTERS[path]: values}) if values else rest.append(f)
        shared, tenants, places = (wanted.get(k) for k in ("shared", "tenants", "location"))
        if self.tenant.central is None and not wanted:
            return df, list(filters)
        fields = df.schema["instances"].dataType.elementType.fieldNames()
        names = tuple(a if a in fields else b for a, b in (("tenant_id", "tenantId"), ("location_id", "locationId")))
        one = lambda v: v[0] if v and len(set(v)) == 1 else None
        elements = consortium.visible_elements(self.tenant, F.col("instances"), one(shared), tenants, one(places), names)
        if places and len(set(places)) > 1:
            elements = F.filter(elements, lambda x: x[names[1]].isin(*places))
        return df.withColumn("instances", elements).where(F.size("instances") > 0), rest

    def store(self, name: str, documents: DataFrame, path: str, parts: int | None = None) -> None:
        """Write a resource's prepared documents and read searches from there on."""
        found = self.resources[name]
        found = replace(found, languages=self.spoken()) if found.language_path in documents.columns else found
        index.write(documents, found, path, parts)
        self.tables[name] = lambda: self.spark.read.parquet(path)

    def store_inverted(self, name: str, path: str, parts: int | None = None) -> None:
        """Write a resource's inverted index; from there on searches without sortBy are ordered by relevance.

        Scores are of all tenants' documents together; which of them a tenant sees is decided on the documents."""
        index.Inverted.of(self.table(name), self.resources[name]).write(path, parts)
        self.inverted[name] = index.Inverted.open(self.spark, path)

    def store_grams(self, name: str, path: str, fields: tuple[str, ...], parts: int | None = None) -> None:
        """Write three-letter postings of fields; from there on conditions with wildcards on them test few rows."""
        index.Grams.of(self.table(name), self.resources[name], fields).write(path, parts)
        self.grams[name] = index.Grams.open(self.spark, path)

    def drop(self, name: str) -> None:
        if self.tables.pop(name, None) is None:
            raise NotFoundError(f"Index {name} does not exist")
        self.inverted.pop(name, None)
        self.grams.pop(name, None)
        for key in [k for k in self.ordered if BROWSES[k[0]][0] == name]:
            del self.ordered[key]

    def configure_languages(self, languages: list[str]) -> None:
        if len(languages) > MOST_LANGUAGES:
            raise ValidationError(f"Tenant is allowed to have only {MOST_LANGUAGES} languages configured")
        if not set(languages) <= set(LANGUAGES):
            raise ValidationError("Language has no analyzer available")
        self.languages = tuple(languages)
