"""Rule sets shared by Spark expressions and SQL."""

from __future__ import annotations

# Query keys that only track visitors (lower case), and prefixes of more of them.
TRACKING_KEYS = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_cid utm_reader utm_name utm_social utm_social-type "
    "fbclid gclid gclsrc dclid gbraid wbraid msclkid twclid li_fat_id mc_cid mc_eid _ga _gl oly_anon_id oly_enc_id "
    "ref source campaign_id campaign medium content keyword affiliate_id click_id fb_action_ids fb_action_types fb_ref fb_source "
    "hsa_cam hsa_grp hsa_mt hsa_src hsa_ad hsa_acc hsa_net hsa_ver hsa_la hsa_ol hsa_kw hsa_tgt hsa_bal hsa_bgt hsa_wn hsa_cr hsa_og hsa_mi "
    "_kx vero_id wickedid yclid __s _hsmi _hsenc si ss spm scm pk_campaign pk_kwd pk_source pk_medium pk_content "
    "_openstat vov vzmid from spm_"
).split()
TRACKING_PREFIXES = ("utm_", "_hs")

# Query keys that never select other content, for canonical keys.
DROP_KEYS = (
    "paged page replytocom add-to-cart added-to-cart remove_item download_item wc-ajax preview no_reply amp consumer_key nonce "
    "utm_source utm_medium utm_campaign utm_term utm_content gclid fbclid msclkid ref source session_id s_id"
).split()
PAGINATION_SEGMENTS = ("page", "paged", "comment-page")

# Path prefixes of routes without content.
NOISE_PREFIXES = (
    "/wp-json /rest/ /wp-admin /wp-login /wp-cron /wp-includes/ /xmlrpc /feed /cart /checkout /my-account /wc-api "
    "/wc-ajax /addons /robots.txt /sitemap /wp-sitemap /oembed/ /.well-known /feed/"
).split()

# Parts of urls that aren't worth resuming.
RESUME_RAW = ("?p=", "_wpnonce", "remove_item", "add-to-cart", "replytocom", "&cpage=")
RESUME_PATHS = "/page/ /author/ /cart /checkout /my-account /oembed /feed /xmlrpc /wp-json /wp-admin /comments /respond /tag/ /trackback/".split()

# Suffixes of html pages.
PAGE_SUFFIXES = "html htm php asp aspx jsp jspx cfm".split()

# What a mime type holds, and the suffix of its files; the first that fits counts.
MIME_SUFFIXES = (
    ("text/html", ".html"),
    ("text/css", ".css"),
    ("javascript", ".js"),
    ("image/png", ".png"),
    ("image/jpeg", ".jpg"),
    ("image/gif", ".gif"),
    ("image/svg", ".svg"),
    ("image/webp", ".webp"),
    ("image/x-icon", ".ico"),
    ("font/woff2", ".woff2"),
    ("font/woff", ".woff"),
    ("font/ttf", ".ttf"),
    ("font/eot", ".eot"),
    ("application/json", ".json"),
    ("application/pdf", ".pdf"),
)
JSON_MIMES = "application/json text/json application/vnd.api+json application/problem+json application/hal+json application/ld+json".split()
API_MIME_PARTS = ("xml", "protobuf", "grpc")
API_PATH_PARTS = "/api/ /graphql /gql /rest/ /v1/ /v2/ /rpc jsonrpc".split()

# Words of an error message that tell its kind; the first that fits counts, case matters.
ERROR_WORDS = (
    ("dns", ("no such host", "DNS", "dns")),
    ("tls", ("tls", "certificate", "handshake")),
    ("timeout", ("timeout", "deadline")),
    ("rate_limit", ("429", "rate limit", "too many")),
    ("blocked", ("403", "blocked", "captcha")),
    ("auth", ("401", "auth", "login")),
    ("network", ("connection refused", "connection reset", "broken pipe")),
    ("oom", ("no memory", "cannot allocate")),
    ("cancelled", ("canceled", "cancelled")),
)
RETRYABLE_KINDS = ("timeout", "network", "rate_limit", "browser", "resource")

# Attributes that hold urls.
URL_ATTRS = "href src action poster".split()
DATA_URL_ATTRS = (
    "data-src data-srcset data-lazy-src data-original data-image data-bg data-background data-href data-url data-srcpath "
    "data-request data-endpoint data-lazy data-delayed-url data-settings"
).split()

# Expressions that find urls in scripts, by the kind that they report.
JS_PATTERNS = (
    ("dynamic-import", r"""import\s*\(\s*["']([^"']+)["']\s*\)"""),
    ("require", r"""require\s*\(\s*["']([^"']+)["']\s*\)"""),
    ("fetch", r"""fetch\s*\(\s*["']([^"']+)["']"""),
    ("xhr-open", r"""\.open\s*\(\s*["'][^"']*["']\s*,\s*["']([^"']+)["']"""),
    ("importScripts", r"""importScripts\s*\(\s*["']([^"']+)["']"""),
    ("system-import", r"""System\.import\s*\(\s*["']([^"']+)["']"""),
    ("axios", r"""axios\s*\.\s*(?:get|post|put|patch|delete|head|options)\s*\(\s*["']([^"']+)["']"""),
    ("jquery-ajax", r"""\$\.ajax\s*\(\s*\{[^}]*url\s*:\s*["']([^"']+)["']"""),
    ("define-async", r"""defineAsyncComponent\s*\(\s*\(\s*\)\s*=>\s*import\s*\(\s*["']([^"']+)["']"""),
    ("react-lazy", r"""React\.lazy\s*\(\s*\(\s*\)\s*=>\s*import\s*\(\s*["']([^"']+)["']"""),
    ("vue-lazy", r"""Vue\.component\s*\(\s*["'][^"']+["']\s*,\s*\(\s*\)\s*=>\s*import\s*\(\s*["']([^"']+)["']"""),
    ("webpack-chunk", r"""webpackChunkName\s*:\s*["']([^"']+)["']"""),
    ("webpack-require", r"""__webpack_require__\s*\(\s*["']([^"']+)["']"""),
)

# Expressions of import maps, of their entries, and of module scripts.
IMPORT_MAP = r"""(?s)<script[^>]*type=["']importmap["'][^>]*>(.*?)</script>"""
IMPORT_ENTRY = r"""["'][^"']+["']\s*:\s*["']([^"']+)["']"""
MODULE_SCRIPT = r"""<script[^>]*type=["']module["'][^>]*src=["']([^"']+)["']"""
