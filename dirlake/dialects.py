"""Directory dialects as data: names, detection patterns and category rules. All tables here are fixed values."""

#: Other spellings of dialect names.
ALIASES = {
    "active_directory": "ad", "activedirectory": "ad", "oracle_oid": "oid", "oracleoid": "oid", "oracle_oud": "oud", "oracleoud": "oud", "openldap": "openldap2", "openldap1": "openldap1", "openldap2": "openldap2",
    "ibm_tivoli": "ibm_tivoli", "ibmtivoli": "ibm_tivoli", "tivoli": "ibm_tivoli", "novell_edirectory": "novell", "novelledirectory": "novell", "edirectory": "novell",
    "apache_directory": "apache", "apachedirectory": "apache", "apacheds": "apache", "389ds": "ds389", "389directory": "ds389",
}
NAMES = ("rfc", "oid", "oud", "openldap", "openldap1", "openldap2", "ad", "ds389", "apache", "novell", "ibm_tivoli", "relaxed", "generic")

#: dialect, weight, pattern, whether the case of the text counts.
DETECTION = (
    ("oid", 12, r"2\.16\.840\.1\.113894\.|orcl", True),
    ("oud", 14, r"ds-sync-|ds-pwp-|ds-cfg-|root dns", False),
    ("openldap2", 8, r"\b(?:olc[A-Z][a-zA-Z]+|cn=settings)\b", True),
    ("ad", 8, r"1\.2\.840\.113556\.", True),
    ("novell", 6, r"2\.16\.840\.1\.113719\.", False),
    ("ibm_tivoli", 6, r"\b(?:ibm|tivoli|ldapdb)\b", False),
    ("ds389", 6, r"\b(?:389ds|redhat-ds|dirsrv)\b", False),
    ("apache", 6, r"\b(?:apacheds|apache-.*)\b", False),
)
CONFIDENCE, NAME_BONUS, FIRST_LINES = 0.6, 2, 1000

#: dialect: (order of categories, classes that decide for hierarchy at once, classes of each category, attributes of the acl category).
CATEGORIES = {
    "rfc": (("users", "hierarchy", "groups", "acl"), (), {"users": ("person", "inetOrgPerson", "organizationalPerson", "residentialPerson"), "hierarchy": ("organizationalUnit", "organization", "locality", "country"), "groups": ("groupOfNames", "groupOfUniqueNames", "posixGroup")}, ("aci", "acl")),
    "oid": (("acl", "users", "hierarchy", "groups"), ("orclContainer", "organizationalUnit", "organization", "domain"), {"users": ("person", "inetOrgPerson", "orclUser", "orclUserV2"), "hierarchy": ("organizationalUnit", "organization", "domain", "country", "locality", "orclContainer", "orclContainerOC", "orclContext", "orclApplicationEntity", "orclConfigSet", "orclDASAttrCategory", "orclDASOperationURL", "orclDASConfigPublicGroup"), "groups": ("groupOfNames", "groupOfUniqueNames", "orclGroup", "orclPrivilegeGroup")}, ("aci", "orclaci", "orclentrylevelaci")),
    "oud": (("schema", "acl", "users", "hierarchy", "groups", "rejected"), ("organizationalUnit", "organization", "domain"), {"users": ("person", "inetOrgPerson", "organizationalPerson"), "hierarchy": ("organizationalUnit", "organization", "domain", "country", "locality"), "groups": ("groupOfNames", "groupOfUniqueNames")}, ("aci",)),
}
BY_BASE = ("hierarchy", "users", "groups", "acl")

#: What a dialect asks of its entries.
RULES = {
    "oid": ("objectclass", "naming", "binary"), "oud": ("objectclass", "naming", "binary"), "openldap": ("binary",), "openldap2": ("binary",),
    "ad": ("objectclass", "naming"), "ds389": ("objectclass",), "novell": ("objectclass",), "ibm_tivoli": ("objectclass",),
}
SCHEMA_DNS = ("cn=subschemasubentry", "cn=subschema", "cn=schema")


#: Object classes of schema entries, and the numbers that mark a dialect's definitions.
SCHEMA_CLASSES = ("subschema", "subentry")
OID_SIGNS = {
    "oid": r"2\.16\.840\.1\.113894\.|orcl", "oud": r"(?i)ds-sync-|ds-pwp-|ds-cfg-|root dns", "ad": r"1\.2\.840\.113556\.", "apache": r"1\.3\.6\.1\.4\.1\.18060\.", "ds389": r"2\.16\.840\.1\.113730\.",
    "novell": r"2\.16\.840\.1\.113719\.", "openldap1": r"1\.3\.6\.1\.4\.1\.4203\.", "openldap2": r"1\.3\.6\.1\.4\.1\.4203\.", "ibm_tivoli": r"\b1\.3\.18\.",
}
#: Attributes and first words of a dialect's access rules.
RULE_SIGNS = {
    "rfc": (("aci",), ()), "oud": (("aci",), ("(target", "(version")), "ds389": (("aci",), ("(target", "(version")), "oid": (("orclaci", "orclentrylevelaci"), ("access to entry", "access to attr")),
    "openldap2": (("olcAccess",), ("to ", "{")), "openldap1": (("access",), ("access to",)), "novell": (("acl", "aclRights"), ()), "ad": (("nTSecurityDescriptor",), ("o:", "d:", "g:", "s:")), "ibm_tivoli": (("ibm-filterAclEntry", "aclEntry"), ("access ",)),
}
#: What matching rules and syntaxes of one dialect are in the others.
RULES_IN = {"caseIgnoreSubStringsMatch": "caseIgnoreSubstringsMatch", "accessDirectiveMatch": "caseIgnoreMatch", "distinguishedNAMEMatch": "distinguishedNameMatch", "DistinguishedNameMatch": "distinguishedNameMatch", "caseIgnoreSubstringMatch": "caseIgnoreSubstringsMatch", "CaseIgnoreMatch": "caseIgnoreMatch", "CaseExactMatch": "caseExactMatch"}
SYNTAXES_IN = {"1.3.6.1.4.1.1466.115.121.1.1": "1.3.6.1.4.1.1466.115.121.1.15"}


def resolve(name: str) -> str:
    """The dialect of a name in any spelling; an unknown one is an error."""
    low = name.strip().lower()
    low = ALIASES.get(low, low)
    if low not in NAMES:
        raise ValueError(f"unknown dialect: {name}")
    return low


class Signature:
    """What an entry of a dialect looks like: parts of its name, starts of its attribute names, its object classes, and words in either."""

    def __init__(self, dn: tuple[str, ...] = (), prefixes: tuple[str, ...] = (), classes: tuple[str, ...] = (), attributes: tuple[str, ...] = ()) -> None:
        self.dn, self.prefixes, self.classes, self.attributes = dn, prefixes, classes, attributes


SIGNATURES = {
    "ad": Signature(("cn=users", "cn=computers", "cn=configuration", "cn=system", "ou=domain controllers"), (), ("user", "computer", "group", "domainpolicy", "foreignsecurityprincipal", "msds-groupmanagedserviceaccount", "msds-managedserviceaccount"), ("objectguid", "objectsid", "samaccountname", "userprincipalname", "ntsecuritydescriptor")),
    "ds389": Signature(("cn=monitor", "cn=changelog"), ("nsslapd-", "nsds", "nsuniqueid"), ("nscontainer", "nsperson", "nsds5replica", "nsds5replicationagreement", "nsorganizationalunit", "nsorganizationalperson")),
    "openldap2": Signature(("cn=settings", "cn=monitor"), ("olc",), ("olcglobal", "olcdatabaseconfig", "olcldapconfig", "olcmdbconfig", "olcbdbconfig")),
    "openldap1": Signature((), ("attributetype", "objectclass ", "access ", "rootdn"), ()),
    "novell": Signature(("ou=services", "ou=apps", "ou=system"), ("nspm", "login", "dirxml-"), ("ndsperson", "nspmpasswordpolicy", "ndsserver", "ndstree", "ndsloginproperties"), ("nspmpasswordpolicydn", "guid")),
    "ibm_tivoli": Signature(("cn=ibm",), ("ibm-", "ids-"), ()),
    "apache": Signature(("ou=config",), ("ads-", "apacheds"), ()),
    "oid": Signature(("cn=orcl", "ou=oracle"), ("orcl",), ("orcluser", "orcluserv2", "orclcontainer", "orclgroup", "orclprivilegegroup")),
    "oud": Signature(("cn=root dns",), ("ds-sync-", "ds-pwp-", "ds-cfg-"), ()),
}
#: Structural classes of which an entry has one, and attributes that a domain may not have.
STRUCTURAL = ("domain", "organization", "organizationalunit", "person", "groupofuniquenames", "groupofnames", "orclsubscriber", "orclgroup")
NOT_IN_DOMAIN = ("cn", "uniquemember", "member", "orclsubscriberfullname", "orclversion", "orclgroupcreatedate")
