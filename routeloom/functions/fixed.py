"""Fixed values. Results depend on them, so they are kept as plain text in one place."""

# Networks treated as Tier-1.
TIER1 = [174, 701, 702, 1239, 1299, 2828, 2914, 3257, 3320, 3356, 3491, 5511, 6453, 6461, 6762, 6830,
         6939, 7018, 7473, 12956, 1273, 3549, 3551, 209]

# Share of origin-side evidence at or above which a neighbour is a customer, at or below which a provider.
CUSTOMER_SHARE = 0.8
PROVIDER_SHARE = 0.2

# Origin validation codes.
RPKI_LABELS = {0: "NotFound", 1: "Valid", 2: "Invalid-ASN", 3: "Invalid-length"}
IRR_LABELS = {0: "none", 1: "present", 2: "mismatch"}
AUTHORITATIVE = ["RIPE", "APNIC", "ARIN", "AFRINIC", "LACNIC", "DN42"]
SET_SOURCE_ORDER = ["RIPE", "APNIC", "ARIN", "AFRINIC", "LACNIC", "RIPE-NONAUTH", "RADB", "DN42"]

# Second-level labels that extend the public suffix.
SECOND_LEVEL = ["co", "com", "net", "org", "gov", "edu", "ac", "or", "ne", "go", "gr", "lg", "ed", "ad",
                "sch", "mil", "in", "idv", "asn", "id", "biz", "info", "name"]

# Provider priority when geo intervals overlap; anything else counts as 1.
GEO_PRIORITY = {"ipdb": 3, "geolite": 2}

# Country names that override any other source.
COUNTRY_OVERRIDE = {
    "zh": {"CN": "中国大陆", "TW": "中国台湾", "MO": "中国澳门", "HK": "中国香港"},
    "en": {"CN": "Chinese Mainland", "TW": "Taiwan, China", "MO": "Macao", "HK": "Hong Kong"},
}

# Country centroids (latitude, longitude) and the default when a country is unknown.
CENTROIDS = {
    "CN": (35.0, 103.0), "HK": (22.32, 114.17), "TW": (23.7, 121.0), "MO": (22.16, 113.55),
    "JP": (36.2, 138.3), "KR": (36.5, 127.9), "SG": (1.35, 103.82), "MY": (4.2, 101.9),
    "TH": (15.0, 101.0), "VN": (16.2, 107.8), "IN": (22.0, 79.0), "ID": (-2.5, 118.0),
    "PH": (12.8, 121.8), "AU": (-25.0, 134.0), "NZ": (-41.0, 174.0), "US": (39.0, -98.0),
    "CA": (56.0, -106.0), "MX": (23.6, -102.5), "BR": (-10.0, -52.0), "AR": (-34.0, -64.0),
    "GB": (54.0, -2.0), "IE": (53.4, -8.0), "FR": (46.6, 2.4), "DE": (51.2, 10.4), "NL": (52.2, 5.3),
    "BE": (50.6, 4.6), "LU": (49.8, 6.1), "CH": (46.8, 8.2), "AT": (47.6, 14.1), "IT": (42.8, 12.8),
    "ES": (40.0, -3.7), "PT": (39.6, -8.0), "SE": (62.0, 15.0), "NO": (64.0, 11.0), "FI": (64.0, 26.0),
    "DK": (56.0, 9.5), "PL": (52.0, 19.0), "CZ": (49.8, 15.5), "RU": (61.5, 99.0), "UA": (48.4, 31.2),
    "TR": (39.0, 35.2), "IL": (31.4, 35.0), "AE": (24.0, 54.0), "SA": (24.0, 45.0), "ZA": (-29.0, 24.0),
    "EG": (26.8, 30.8), "NG": (9.1, 8.7), "KE": (0.2, 37.9),
}
UNKNOWN_PLACE = (20.0, 0.0)

# Representative city of each Tier-1 (latitude, longitude).
TIER1_PLACES = {
    2914: (35.6762, 139.6503), 3491: (22.3193, 114.1694), 7473: (1.3521, 103.8198),
    6453: (19.0760, 72.8777), 1299: (59.3293, 18.0686), 1273: (51.5074, -0.1278),
    5511: (48.8566, 2.3522), 3320: (50.1109, 8.6821), 702: (52.3676, 4.9041),
    12956: (40.4168, -3.7038), 6762: (38.1157, 13.3615), 3257: (45.4642, 9.1900),
    6830: (48.2082, 16.3738), 701: (39.0438, -77.4874), 174: (38.9072, -77.0369),
    3551: (42.3601, -71.0589), 3549: (25.7617, -80.1918), 6461: (41.8781, -87.6298),
    1239: (39.0997, -94.5786), 7018: (32.7767, -96.7970), 3356: (39.7392, -104.9903),
    209: (34.0522, -118.2437), 6939: (37.5485, -121.9886), 2828: (47.6062, -122.3321),
}

# DNS record types asked for and their codes.
DNS_TYPES = {"A": 1, "AAAA": 28, "CNAME": 5, "NS": 2, "MX": 15, "TXT": 16, "SOA": 6, "CAA": 257}

# vCard properties and event actions with their field names.
VCARD_FIELDS = {"fn": "fullname", "org": "org", "adr": "address", "tel": "phone", "email": "email",
                "kind": "kind", "role": "role", "title": "title", "url": "url"}
EVENT_FIELDS = {"registration": "registration", "last changed": "lastchanged", "expiration": "expiration",
                "reregistration": "lastchanged"}

# Attributes never shown from registry objects.
HIDDEN_ATTRIBUTES = ["auth", "pgp-fingerprint"]

# WHOIS column names seen in the wild, by field.
WHOIS_LABELS = {
    "ldhname": ["domain", "domain name", "domainname", "domain_name", "nom de domaine", "nombre de dominio",
                "ドメイン名"],
    "org": ["org", "organization", "organisation", "organization name", "org-name", "holder",
            "holder of domain name", "owner", "owner name", "owner contact", "registrant", "registrant name",
            "registrant org", "registrant organization", "registrant organisation", "registrant contact",
            "registrant contact name", "descr", "titular", "company english name",
            "organization using domain name", "domain holder organization", "組織名", "そしきめい"],
    "registrar": ["registrar", "registrar name", "registrar-name", "registrar handle", "sponsoring registrar",
                  "sponsoring registrar organization", "authorized agency", "registration service provider",
                  "record maintained by", "registered by"],
    "registration": ["created", "created on", "created date", "creation date", "creationdate", "registered",
                     "registered on", "registered date", "registration date", "registration time",
                     "record created", "record created on", "domain created", "domain registered",
                     "domain registration date", "domain record activated", "domain name commencement date",
                     "first registration date", "domain_dateregistered", "date de création", "登録年月日"],
    "lastchanged": ["changed", "modified", "modified date", "modification date", "updated", "updated date",
                    "updated on", "updateddate", "last update", "last-update", "last updated", "last-updated",
                    "last updated on", "last updated date", "last modified", "record last updated on",
                    "domain record last updated", "domain last updated date", "entry updated",
                    "domain_datelastmodified", "dernière modification", "最終更新"],
    "expiration": ["expire", "expires", "expires on", "expire date", "expire-date", "expiry", "expiry date",
                   "exp date", "expiration", "expiration date", "expiration time", "registry expiry date",
                   "registrar registration expiration date", "record expires on", "record will expire on",
                   "domain expires", "domain expiration date", "paid-till", "valid until", "validity",
                   "renewal", "renewal date", "domain_datebilleduntil", "date d'expiration"],
    "status": ["status", "state", "domain status", "registration status", "registry status",
               "transfer status", "query_status", "statut", "状態"],
    "ns": ["nserver", "nameserver", "nameservers", "name server", "name servers", "name servers information",
           "name server information", "name servers in the listed order", "domain servers in listed order",
           "domain name servers", "domain nameservers", "dns servers", "host name", "hostname",
           "serveur de noms", "ネームサーバ"],
    "dnssec": ["dnssec", "signed", "signed delegation", "domain_signed", "nsec", "signing key", "署名鍵"],
    "country": ["country", "registrant country", "registrant-country", "org-country", "domain holder country",
                "registrant country/economy", "país"],
    "email": ["e-mail", "email", "holder email", "registrant contact email"],
}
# A bracketed WHOIS label and its value.
WHOIS_BRACKET = r"(?i)^(?:[a-z]\.\s*)?\[(\S[^\]]*?)\]\s+(.+)$"
WHOIS_NS_HEADERS = ["name servers", "nameservers", "name server", "domain servers", "name servers information",
                    "name servers in the listed order", "domain servers in listed order",
                    "domain name servers", "domain nameservers"]
WHOIS_HIDDEN_VALUE = r"(?i)^(redacted|not disclosed|gdpr|please visit|see )"
