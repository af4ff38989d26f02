"""Tables of the registry: columns, keys, source files and load rules."""

from __future__ import annotations

from dataclasses import dataclass, field

# Code categories that are loaded, in Dutch.
CODE_LANGUAGE = "NL"
CODE_CATEGORIES = [
    "ContactType",
    "EntityContact",
    "JuridicalForm",
    "JuridicalSituation",
    "Language",
    "Status",
    "TypeOfAddress",
    "TypeOfDenomination",
    "TypeOfEnterprise",
]
ADDRESS_TYPES = ["REGO", "BAET"]
REGISTERED_OFFICE = "REGO"
CONTACT_CODES = ["ENT", "EST"]
NAME_LANGUAGES = ("NL", "FR")
DEFAULT_COUNTRY = "BE"
UNKNOWN_POSTAL_CODE = "Unknown"


@dataclass(frozen=True)
class TableSpec:
    name: str
    file: str
    source_columns: list[str]
    source_key: list[str]
    key: list[str]
    columns: list[str]
    always_replace: bool = False
    cleared_on_reset: bool = True


# Table, file, column and key names, in load order.
TABLES = {
    spec.name: spec
    for spec in [
        TableSpec(
            "Code",
            "code.csv",
            ["Category", "Code", "Language", "Description"],
            ["Category", "Code"],
            ["category", "code"],
            ["category", "code", "description"],
            always_replace=True,
            cleared_on_reset=False,
        ),
        TableSpec(
            "Enterprise",
            "enterprise.csv",
            [
                "EnterpriseNumber",
                "Status",
                "JuridicalSituation",
                "TypeOfEnterprise",
                "JuridicalForm",
                "JuridicalFormCAC",
                "StartDate",
            ],
            ["EnterpriseNumber"],
            ["enterpriseNumber"],
            [
                "enterpriseNumber",
                "KBOstatusCode",
                "juridicalSituationCode",
                "typeOfEnterpriseCode",
                "juridicalFormCode",
                "juridicalFormCACCode",
                "startDate",
            ],
        ),
        TableSpec(
            "Establishment",
            "establishment.csv",
            ["EstablishmentNumber", "StartDate", "EnterpriseNumber"],
            ["EstablishmentNumber"],
            ["establishmentNumber"],
            ["establishmentNumber", "startDate", "enterpriseNumber"],
        ),
        TableSpec(
            "Branch",
            "branch.csv",
            ["Id", "StartDate", "EnterpriseNumber"],
            ["Id"],
            ["id"],
            ["id", "startDate", "enterpriseNumber"],
            cleared_on_reset=False,
        ),
        TableSpec(
            "KBOAddress",
            "address.csv",
            [
                "EntityNumber",
                "TypeOfAddress",
                "CountryNL",
                "CountryFR",
                "Zipcode",
                "MunicipalityNL",
                "MunicipalityFR",
                "StreetNL",
                "StreetFR",
                "HouseNumber",
                "Box",
                "ExtraAddressInfo",
                "DateStrikingOff",
            ],
            ["EntityNumber", "TypeOfAddress"],
            ["entityNumber", "typeOfAddressCode"],
            [
                "entityNumber",
                "typeOfAddressCode",
                "countryNL",
                "countryFR",
                "zipcode",
                "municipalityNL",
                "municipalityFR",
                "streetNL",
                "streetFR",
                "houseNumber",
                "box",
                "extraAddressInfo",
                "dateStrikingOff",
                "enterpriseId",
                "establishmentId",
            ],
        ),
        TableSpec(
            "KBOContact",
            "contact.csv",
            ["EntityNumber", "EntityContact", "ContactType", "Value"],
            ["EntityNumber", "EntityContact", "ContactType"],
            ["entityNumber", "entityContactCode", "conctactTypeCode"],
            [
                "entityNumber",
                "entityContactCode",
                "conctactTypeCode",
                "value",
                "enterpriseId",
                "establishmentId",
            ],
        ),
        TableSpec(
            "Denomination",
            "denomination.csv",
            ["EntityNumber", "Language", "TypeOfDenomination", "Denomination"],
            ["EntityNumber", "Language", "TypeOfDenomination"],
            ["entityNumber", "languageCode", "typeOfDenominationCode"],
            [
                "entityNumber",
                "languageCode",
                "typeOfDenominationCode",
                "denomination",
                "enterpriseId",
                "establishmentId",
            ],
        ),
        TableSpec(
            "Activity",
            "activity.csv",
            ["EntityNumber", "ActivityGroup", "NaceVersion", "NaceCode", "Classification"],
            ["EntityNumber", "ActivityGroup", "NaceVersion", "NaceCode", "Classification"],
            [
                "entityNumber",
                "activityGroupCode",
                "naceVersion",
                "naceCode",
                "classification",
            ],
            [
                "entityNumber",
                "activityGroupCode",
                "naceVersion",
                "naceCode",
                "classification",
                "enterpriseId",
                "establishmentId",
            ],
        ),
        TableSpec(
            "Meta",
            "meta.csv",
            ["Variable", "Value"],
            ["Variable"],
            ["variable"],
            ["variable", "value"],
            always_replace=True,
            cleared_on_reset=False,
        ),
    ]
}


@dataclass(frozen=True)
class Relation:
    """A foreign key: ``child.column`` must occur in ``parent``'s key."""

    child: str
    column: str
    parent: str
    category: str | None = field(default=None)

    @property
    def name(self) -> str:
        return f"{self.child}.{self.column}"


# The foreign keys of the registry.
RELATIONS = [
    Relation("Enterprise", "KBOstatusCode", "Code", "Status"),
    Relation("Enterprise", "juridicalSituationCode", "Code", "JuridicalSituation"),
    Relation("Enterprise", "typeOfEnterpriseCode", "Code", "TypeOfEnterprise"),
    Relation("Enterprise", "juridicalFormCode", "Code", "JuridicalForm"),
    Relation("Enterprise", "juridicalFormCACCode", "Code", "JuridicalForm"),
    Relation("Establishment", "enterpriseNumber", "Enterprise"),
    Relation("Denomination", "languageCode", "Code", "Language"),
    Relation("Denomination", "typeOfDenominationCode", "Code", "TypeOfDenomination"),
    Relation("Denomination", "enterpriseId", "Enterprise"),
    Relation("Denomination", "establishmentId", "Establishment"),
    Relation("KBOAddress", "typeOfAddressCode", "Code", "TypeOfAddress"),
    Relation("KBOAddress", "enterpriseId", "Enterprise"),
    Relation("KBOAddress", "establishmentId", "Establishment"),
    Relation("KBOContact", "entityContactCode", "Code", "EntityContact"),
    Relation("KBOContact", "conctactTypeCode", "Code", "ContactType"),
    Relation("KBOContact", "enterpriseId", "Enterprise"),
    Relation("KBOContact", "establishmentId", "Establishment"),
    Relation("Branch", "enterpriseNumber", "Enterprise"),
    Relation("Activity", "enterpriseId", "Enterprise"),
    Relation("Activity", "establishmentId", "Establishment"),
]
