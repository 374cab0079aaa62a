"""Values that the engine's results depend on."""

from __future__ import annotations

# The class of each type; types that are not listed are infra.
CLASS_OF = {
    "CERTIFICATE": "secret", "CRYPTOGRAPHIC_KEY": "secret", "PASSWORD": "secret", "AUTH_TOKEN": "secret", "PGP_BLOCK": "secret",
    "COOKIE_SESSION": "secret", "API_KEY": "secret", "CREDIT_CARD": "secret", "JWT": "secret", "PRIVATE_KEY_PEM": "secret",
    "PASSWORD_CONTEXT": "secret", "RSA_MODULUS": "secret", "CERT_PEM": "secret", "CERT_REQUEST_PEM": "secret", "CERT_DER": "secret",
    "IBAN_CODE": "pii", "EMAIL_ADDRESS": "pii", "PERSON": "pii", "PHONE_NUMBER": "pii", "USERNAME": "pii", "USERNAME_CONTEXT": "pii",
    "USER_PATH": "pii", "CPF": "pii",
    "CVE_ID": "public", "CPE": "public", "CPE_STRING": "public", "OID": "public", "PORT": "public", "MALWARE": "public",
    "THREAT_ACTOR": "public", "MITRE_TACTIC": "public", "PLATFORM": "public", "PRODUCT": "public", "TOOL": "public", "SECTOR": "public",
    "CAMPAIGN": "public", "SERVICE": "public",
}
DEFAULT_CLASS = "infra"

# Which type wins an overlap among equally long spans; types that are not listed have 6.
PRIORITY_OF = {
    "PRIVATE_KEY_PEM": 0, "PGP_BLOCK": 0, "CERTIFICATE": 0,
    "JWT": 1, "AUTH_TOKEN": 1, "CRYPTOGRAPHIC_KEY": 1, "PASSWORD": 1, "API_KEY": 1, "COOKIE_SESSION": 1, "PASSWORD_CONTEXT": 1,
    "RSA_MODULUS": 1, "CERT_PEM": 1, "CERT_REQUEST_PEM": 1, "CERT_DER": 1,
    "CREDIT_CARD": 2, "IBAN_CODE": 2, "CPF": 2,
    "UUID": 3, "COMMIT_SHA": 3, "HASH": 3, "CERT_THUMBPRINT": 3, "CERT_SERIAL": 3, "MAC_ADDRESS": 3,
    "CONTAINER_IMAGE": 4, "REPO": 4, "URL": 5, "FILE_PATH": 5, "USER_PATH": 5, "EMAIL_ADDRESS": 6,
    "HOSTNAME": 7, "FQDN": 7, "HEX_HOSTNAME": 7, "CERT_CN": 7, "K8S_NAMESPACE": 7, "SERVICE_ACCOUNT": 7, "IP_ADDRESS": 8,
    "PERSON": 9, "ORGANIZATION": 9, "LOCATION": 9, "USERNAME_CONTEXT": 9,
}
DEFAULT_PRIORITY = 6

# Marks of internal hosts, of environments and of service accounts, and the forges whose paths are repositories.
INTERNAL_SUFFIXES = (".internal", ".local", ".lan", ".intra", ".corp", ".home.arpa", ".svc.cluster.local", ".cluster.local")
ENVIRONMENTS = ("prod", "production", "staging", "stage", "preprod", "uat", "qa", "dev", "development", "test", "sandbox", "canary", "demo", "int")
ENVIRONMENT_ALIAS = {"production": "prod", "stage": "staging", "development": "dev"}
SERVICE_PREFIXES = ("svc-", "sa-", "srv-", "service-", "system:", "bot-", "ci-")
SERVICE_SUFFIXES = ("-svc", "-sa", "-bot", "-agent", "-runner", "-job", "-operator")
FORGES = ("github.com", "gitlab.com", "bitbucket.org", "codeberg.org")

# Token formats by type, with scores and what every token of the format has.
TOKEN_FORMATS = (
    ("AUTH_TOKEN", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{16,}\b", 0.95, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("AUTH_TOKEN", r"\bgithub_pat_[A-Za-z0-9_]{20,}\b", 0.95, ("github_pat_",)),
    ("AUTH_TOKEN", r"\bglpat-[A-Za-z0-9_-]{16,}\b", 0.95, ("glpat-",)),
    ("AUTH_TOKEN", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", 0.95, ("xox",)),
    ("AUTH_TOKEN", r"\bsk-[A-Za-z0-9_-]{20,}\b", 0.9, ("sk-",)),
    ("AUTH_TOKEN", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", 0.95, ("AKIA", "ASIA")),
    ("AUTH_TOKEN", r"\bdop_v1_[a-f0-9]{32,}\b", 0.95, ("dop_v1_",)),
    ("AUTH_TOKEN", r"\bnpm_[A-Za-z0-9]{30,}\b", 0.95, ("npm_",)),
    ("IBAN_CODE", r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b", 0.92, ()),
)

# By country code, the leading digits of national numbers that are set aside for fiction; X is any area code's three.
FICTION_NUMBERS = {
    "1": ("NXX55501",), "33": ("19900", "26191", "35301", "46571", "53649", "63998"), "44": ("7700900", "2079460", "1134960", "1144960", "1154960", "1164960", "1174960", "1184960", "1214960", "1314960", "1414960", "1514960", "1614960"),
    "61": ("25550", "35550", "75550", "85550", "491570"), "46": ("3139006", "4062804", "8465004", "9803192", "7017406"),
}

# Directories whose names are public, and endings of files that tell only a format.
PUBLIC_DIRECTORIES = (
    "bin", "boot", "dev", "etc", "home", "lib", "lib64", "media", "mnt", "opt", "proc", "root", "run", "sbin", "srv", "sys", "tmp", "usr", "var", "Users", "Library", "Applications", "local", "share", "log", "logs", "cache", "spool",
    "src", "test", "tests", "docs", "config", "data", "build", "dist", "target", "include", "scripts", "assets", "static", "public", "templates", "node_modules", "site-packages", "Documents", "Downloads", "Desktop", ".config", ".cache", "C:",
)
PUBLIC_EXTENSIONS = (
    "c", "h", "cc", "cpp", "cs", "css", "csv", "go", "html", "ini", "ipynb", "java", "jpg", "js", "json", "jsx", "kt", "lock", "log", "md", "parquet", "pdf", "php", "png", "proto", "py", "rb", "rs", "scala", "sh", "sql", "svg", "swift", "tar", "tf",
    "toml", "ts", "tsx", "txt", "xml", "yaml", "yml", "zip", "gz", "docx", "xlsx", "pptx", "conf", "cfg", "env", "pem", "key", "crt",
)
# Words by which a postal address names its way, in the languages of the recogniser, and their order with the name.
WAYS_BEFORE = ("rue", "avenue", "boulevard", "place", "chemin", "impasse", "allée", "quai", "route", "calle", "plaza", "paseo", "via", "piazza")
WAYS_AFTER = ("street", "road", "lane", "drive", "court", "square", "way", "close", "terrace", "avenue", "boulevard")
WAYS_JOINED = ("straße", "strasse", "weg", "platz", "gasse", "allee")

# Words of surrogates, our own; any list would do, as nothing depends on the words themselves.
SERVICE_WORDS = (
    "amber", "anvil", "aspen", "basil", "beacon", "birch", "bramble", "breeze", "cedar", "cinder", "clover", "cobalt", "comet", "coral", "crane", "dahlia",
    "delta", "drift", "ember", "falcon", "fern", "flint", "garnet", "glade", "harbor", "hazel", "heron", "indigo", "iris", "jasper", "juniper", "kelp",
    "lantern", "laurel", "linden", "lotus", "maple", "meadow", "mistral", "nectar", "nimbus", "onyx", "opal", "orchid", "osprey", "pebble", "pine", "quartz",
    "quill", "raven", "reed", "ridge", "saffron", "sage", "sierra", "slate", "sparrow", "spruce", "thistle", "topaz", "tundra", "velvet", "willow", "zephyr",
)
ORG_WORDS = (
    "arden", "bellmont", "caldera", "dunmore", "eastvale", "fairmont", "glenrock", "halcyon", "ironwood", "kestrel", "larkspur", "merrow", "northgate",
    "oakhurst", "pellham", "queensway", "rosedale", "stonebridge", "thornbury", "umberfield", "vantage", "westmere", "yarrow", "zenith",
)
FIRST_NAMES = ("alma", "boris", "clara", "dario", "elena", "felix", "greta", "hugo", "ines", "jonas", "karin", "luca", "marta", "nils", "olga", "pavel", "rosa", "stefan", "tessa", "viktor")
LAST_PARTS = ("ander", "berg", "castel", "dorn", "elm", "farn", "gold", "hart", "isen", "karl", "lind", "mont", "nord", "oster", "palm", "reuter", "sand", "tal", "ulmen", "wald")
ROLES = ("api", "batch", "cache", "gateway", "index", "queue", "relay", "store", "sync", "worker")
FICTIONAL_TLDS = ("example", "test", "invalid")
