"""What the generator may say about each label, and how much of it each regime takes: plain tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .intent import REGIMES


@dataclass(frozen=True)
class Policy:
    #: label -> attributes that can be filtered
    filterable: dict[str, list[str]]
    #: label -> attribute -> operators; "General" holds for any label without an entry of its own
    operators: dict[str, dict[str, list[str]]]
    #: label -> attribute -> (least, most) of integers or a list to choose from; "General" as above
    values: dict[str, dict[str, tuple | list]]
    #: label -> (attribute, operator) that any filters on it must include
    mandatory: dict[str, list[tuple[str, str]]]
    #: attributes whose bounds must leave room
    numeric: list[str]
    aggregatable: dict[str, list[str]]
    #: attribute -> functions
    functions: dict[str, list[str]]
    orderable: dict[str, list[str]]
    #: label -> projections, the first of them the plain one
    returns: dict[str, list[list[str]]]
    #: label -> (labels a step may lead to, most steps from it, whether a label may come again)
    paths: dict[str, tuple[list[str], int, bool]]
    #: label -> attribute -> kind that questions can speak of
    visible: dict[str, dict[str, str]]
    count_labels: list[str]

    def operators_of(self, label: str, attribute: str) -> list[str]:
        return self.operators.get(label, {}).get(attribute) or self.operators.get("General", {}).get(attribute, [])

    def values_of(self, label: str, attribute: str) -> tuple | list:
        return self.values.get(label, {}).get(attribute) or self.values.get("General", {}).get(attribute) or [default_value(attribute)]

    def projections_of(self, label: str, aggregate: dict | None = None) -> list[list[str]]:
        if aggregate is not None:
            return [[]] if aggregate["function"] == "count" else [[aggregate["attribute"]]]
        return self.returns.get(label, [["name"]])

    def functions_of(self, attribute: str | None) -> list[str]:
        return ["count"] if attribute is None else self.functions.get(attribute, [])


def default_value(attribute: str):
    """A likely value where no table has one, from the attribute's name."""
    return next((v for k, v in DEFAULTS if k in attribute.lower()), 0)


@dataclass(frozen=True)
class Regime:
    """Knobs of one regime; 0 of orders or limits means no cap."""

    depth: int
    aggregation: bool = False
    order: bool = False
    limit: bool = False
    multiple: bool = True
    filters: int = 4
    paths: int = 2000
    projections: int = 25
    combinations: int = 120
    orders: int = 0
    limits: int = 0

    def __post_init__(self):
        _check(self.depth >= 0, "depth is 0 or more")
        _check(self.filters >= 0, "filters is 0 or more")
        _check(min(self.paths, self.projections, self.combinations) > 0, "caps are above 0")
        _check(self.orders >= 0 and self.limits >= 0, "caps of orders and limits are 0 or more")


@dataclass(frozen=True)
class Config:
    """What all regimes share."""

    operators_per_attribute: int = 2
    deduplicate: bool = True
    limit_values: tuple[int, ...] = (5, 10, 20)
    directions: tuple[str, ...] = ("asc", "desc")
    min_per_bucket: int = 200
    max_per_bucket: int | None = 500
    target_per_regime: int | None = None
    seed: int = 42
    regimes: dict[str, Regime] = field(default_factory=dict)

    def __post_init__(self):
        _check(self.operators_per_attribute > 0, "operators_per_attribute is above 0")
        _check(all(v > 0 for v in self.limit_values), "limits are above 0")
        _check(all(d in ("asc", "desc") for d in self.directions), "directions are asc or desc")
        _check(self.target_per_regime is None or self.target_per_regime > 0, "target_per_regime is above 0")
        _check(self.min_per_bucket > 0, "min_per_bucket is above 0")
        _check(self.max_per_bucket is None or self.max_per_bucket > 0, "max_per_bucket is above 0")
        _check(all(r in REGIMES for r in self.regimes), "unknown regime")


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


#: Names of the knobs in configuration files.
KNOBS = {
    "max_depth": "depth", "allow_aggregation": "aggregation", "allow_order_by": "order", "allow_limit": "limit", "allow_multiple_filters": "multiple", "max_filters_per_node": "filters",
    "max_paths": "paths", "max_projection_samples": "projections", "max_filter_combinations": "combinations", "max_order_attributes": "orders", "max_limit_variants": "limits",
}
SHARED = {
    "max_operators_per_attribute": "operators_per_attribute", "deduplicate_structures": "deduplicate", "limit_values": "limit_values", "order_by_directions": "directions",
    "min_per_bucket": "min_per_bucket", "max_per_bucket": "max_per_bucket", "target_per_regime": "target_per_regime", "seed": "seed",
}


def overlay(base: Config, regimes: dict[str, dict]) -> Config:
    """base with the knobs of each named regime laid over those it has, or over the defaults of the table below."""
    done = dict(base.regimes)
    for name, knobs in regimes.items():
        unknown = [k for k in knobs if k not in KNOBS]
        _check(not unknown, f"unknown knobs {unknown} of {name}")
        done[name] = replace(done.get(name) or CAPS.get(name) or Regime(0), **{KNOBS[k]: v for k, v in knobs.items()})
    return replace(base, regimes=done)


def configured(raw: dict, regimes: dict[str, dict] | None = None) -> Config:
    """A configuration read from files: the shared settings, and the knobs by regime (all regimes of the table, if none)."""
    known = {SHARED[k]: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in SHARED}
    return overlay(Config(**known, regimes=dict(CAPS) if regimes is None else {}), regimes or {})


# -- fixed values: attribute policies, knobs and word lists of the published generator --------------------------------------

DEFAULTS = [("rate", 70), ("income", 3000), ("population", 10000), ("count", 50), ("length", 500), ("speed", 50), ("name", "Unknown"), ("type", "unknown"), ("date", 2022)]

PLACES = Policy(
    filterable={
        "Place": ["rating", "num_reviews", "type"],
        "Neighborhood": ["name", "area_km2", "average_monthly_income", "total_resident_population"],
        "Road": ["name", "highway", "length", "maxspeed", "oneway"],
        "Intersection": ["highway", "street_count"],
        "Review": ["author", "rating", "date"],
    },
    operators={
        "Neighborhood": {
            "name": ["=", "contains"], "literacy_rate": [">", "<", ">=", "<="], "average_monthly_income": [">", "<", ">=", "<="], "area_km2": [">", "<", ">=", "<="],
            "population_with_income": ["=", ">", "<"], "total_resident_population": ["=", ">", "<"], "total_literate_population": ["=", ">", "<"],
        },
        "Place": {"name": ["=", "contains"], "type": ["="], "rating": [">", "<", ">=", "<="], "num_reviews": [">", "<", ">=", "<="]},
        "Road": {"name": ["=", "contains"], "length": [">", "<", ">=", "<="], "maxspeed": [">", "<", ">=", "<="]},
        "General": {"date": [">", "<", ">=", "<="]},
    },
    values={
        "Neighborhood": {
            "average_monthly_income": (1000, 12000), "area_km2": (1, 20), "total_resident_population": [5000, 10000, 20000, 50000],
            "name": ["Centro", "Jardim Paulista", "Vila Mariana", "Moema", "Pinheiros"],
        },
        "Place": {
            "rating": [2, 3, 4, 5], "num_reviews": (5, 300), "type": ["pet_store", "veterinary_care"],
            "name": ["Pet Shop Amigo Fiel", "Clínica Veterinária São Francisco", "Pet Care Center", "Mundo Pet", "Casa do Pet"],
        },
        "Road": {"length": (50, 2000), "maxspeed": [30, 40, 50, 60, 80], "name": ["Rua das Flores", "Avenida Paulista", "Rua Augusta", "Rua da Consolação"]},
        "General": {"date": [2020, 2021, 2022, 2023]},
    },
    mandatory={"Place": [("type", "=")]},
    numeric=["rating", "num_reviews", "length", "area_km2", "average_monthly_income", "population_with_income", "street_count", "literacy_rate"],
    aggregatable={
        "Place": ["rating", "num_reviews"],
        "Road": ["length", "maxspeed"],
        "Neighborhood": ["area_km2", "average_monthly_income", "literacy_rate", "population_with_income", "total_literate_population", "total_private_households", "total_resident_population", "street_count"],
    },
    functions={
        "rating": ["count", "avg"], "num_reviews": ["count", "sum"], "length": ["count", "avg", "sum"], "maxspeed": ["count", "avg"], "area_km2": ["count", "avg", "sum"], "average_monthly_income": ["count", "avg"],
        "literacy_rate": ["count", "avg"], "population_with_income": ["count", "sum"], "total_literate_population": ["count", "sum"], "total_private_households": ["count", "sum"],
        "total_resident_population": ["count", "sum"], "street_count": ["count", "sum"],
    },
    orderable={
        "Place": ["name", "rating", "num_reviews"],
        "Neighborhood": ["name", "area_km2", "average_monthly_income", "literacy_rate", "population_with_income", "total_resident_population"],
        "Road": ["name", "length", "maxspeed"],
        "Intersection": ["street_count"],
        "Review": ["rating", "date"],
    },
    returns={"Place": [["name"], ["name", "rating"], ["name", "num_reviews"]], "Review": [["text"], ["text", "rating"]], "Neighborhood": [["name"]], "Road": [["name"]], "Intersection": [["name"]]},
    paths={
        "Neighborhood": (["Place", "Road"], 2, False),
        "Place": (["Review", "Intersection", "Neighborhood"], 3, False),
        "Road": (["Place", "Intersection"], 3, False),
        "Intersection": (["Road"], 3, False),
        "Review": (["Place"], 2, False),
    },
    visible={
        "Place": {"name": "str", "type": "str", "rating": "number", "num_reviews": "int"},
        "Neighborhood": {"name": "str", "area_km2": "number", "average_monthly_income": "number", "total_resident_population": "int"},
        "Road": {"name": "str", "highway": "str", "maxspeed": "number", "oneway": "bool"},
        "Review": {"rating": "number", "text": "str", "author": "str", "date": "str"},
        "Intersection": {"street_count": "int"},
    },
    count_labels=["Place", "Neighborhood", "Review", "Road", "Intersection"],
)
PLACE_PATTERNS = [("Neighborhood", "CONTAINS", "Place")]

CAPS = {
    "simple_lookup_query": Regime(0, paths=2000, projections=25, combinations=120),
    "simple_count_query": Regime(0, aggregation=True, paths=1800, projections=12, combinations=140),
    "simple_aggregation_query": Regime(0, aggregation=True, paths=2500, projections=30, combinations=180, orders=1),
    "simple_ranking_query": Regime(0, order=True, limit=True, filters=2, paths=800, projections=6, combinations=20, orders=1, limits=1),
    "relational_lookup_query": Regime(1, filters=3, paths=5000, projections=60, combinations=500),
    "relational_count_query": Regime(1, aggregation=True, filters=3, paths=4500, projections=40, combinations=500),
    "relational_aggregation_query": Regime(1, aggregation=True, filters=3, paths=5000, projections=60, combinations=600, orders=2),
    "relational_ranking_query": Regime(1, order=True, limit=True, filters=2, paths=1200, projections=12, combinations=80, orders=1, limits=1),
}
DEFAULT = Config(regimes=dict(CAPS))
