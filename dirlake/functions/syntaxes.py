"""Attribute syntaxes: names and kinds of their OIDs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The last part of an OID under PREFIX and its name.
PREFIX = "1.3.6.1.4.1.1466.115.121.1."
NAMES = {
    1: "aci", 2: "access_point", 3: "attribute_type_description", 4: "audio", 5: "binary", 6: "bit_string", 7: "boolean", 8: "certificate", 9: "certificate_list", 10: "certificate_pair",
    11: "country_string", 12: "dn", 13: "data_quality_syntax", 14: "delivery_method", 15: "directory_string", 16: "dit_content_rule_description", 17: "dit_structure_rule_description", 18: "dlexp_time", 19: "dn_with_binary", 20: "dn_with_string",
    21: "directory_string", 22: "enhanced_guide", 23: "facsimile_telephone_number", 24: "fax", 25: "generalized_time", 26: "guide", 27: "ia5_string", 28: "jpeg", 29: "ldap_syntax_description", 30: "matching_rule_description",
    31: "matching_rule_use_description", 32: "mhs_or_address", 33: "modify_increment", 34: "name_and_optional_uid", 35: "name_form_description", 36: "numeric_string", 37: "object_class_description", 38: "oid", 39: "octet_string", 40: "other_mailbox",
    41: "postal_address", 42: "protocol_information", 43: "presentation_address", 44: "printable_string", 50: "telephone_number", 51: "teletex_terminal_identifier", 52: "telex_number", 53: "time_of_day", 54: "utctime", 55: "utf8_string",
    56: "unicode_string", 57: "uui", 58: "substring_assertion",
}
#: Kinds of names; all others are strings.
KINDS = {"boolean": "boolean", "integer": "integer", "numeric_string": "integer", "dn": "dn", "name_and_optional_uid": "dn", "generalized_time": "time", "utctime": "time", "time_of_day": "time", "audio": "binary", "binary": "binary", "certificate": "binary", "certificate_list": "binary", "certificate_pair": "binary", "fax": "binary", "jpeg": "binary", "octet_string": "binary"}


def syntax_name(oid: Column) -> Column:
    """The name of a syntax OID; null for an unknown one."""
    table = F.create_map(*(F.lit(x) for k, v in NAMES.items() for x in (PREFIX + str(k), v)), F.lit("2.5.5.5"), F.lit("integer"))
    return F.element_at(table, oid)


def syntax_kind(oid: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    name = syntax_name(oid)
    return F.when(name.isNotNull(), F.coalesce(F.element_at(table, name), F.lit("string")))
