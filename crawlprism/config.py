"""Study design and the fixed value tables every operator takes as defaults.

All of these are parameters: an operator never reads a module global that the caller cannot replace.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

FIRST_PARTY = "first-party"
INTER_FAMILY = "inter-family third-party"
EXTERNAL = "external third-party"
UNKNOWN_TIER = "unknown"
THIRD_PARTY_TIERS = (INTER_FAMILY, EXTERNAL)
NOT_THIRD_PARTY_TIERS = (FIRST_PARTY, UNKNOWN_TIER)

ENTITY_LEVELS = ("domain", "subsidiary_entity", "parent_entity")
GROUP_LEVELS = ("parent_entity", "subsidiary_entity")

ALPHA = 0.05
FOLD_Y = 600
SMOOTHING_COUNT = 1.0
SMOOTHING_PCT = 0.1


@dataclass(frozen=True)
class Study:
    """The profiles under comparison, in canonical order; the first is the control baseline."""

    profiles: tuple[str, ...]
    alpha: float = ALPHA

    @property
    def baseline(self) -> str:
        if not self.profiles:
            raise ValueError("a study needs at least one profile")
        return self.profiles[0]

    def check(self, *profiles: str) -> None:
        unknown = [p for p in profiles if p not in self.profiles]
        if unknown:
            raise ValueError(f"unknown profile(s) {unknown}; configured: {list(self.profiles)}")

    def resolve_baseline(self, baseline: str | None = None) -> str:
        baseline = self.baseline if baseline is None else baseline
        self.check(baseline)
        return baseline

    def resolve_pair(self, a: str | None = None, b: str | None = None) -> tuple[str, str]:
        """Both profiles, or neither: then the second configured one against the baseline."""
        if (a is None) != (b is None):
            raise ValueError("give both profiles of a pair, or neither")
        if a is None:
            if len(self.profiles) < 2:
                raise ValueError("a pair needs two configured profiles")
            a, b = self.profiles[1], self.profiles[0]
        self.check(a, b)
        return a, b

    def others(self, profile: str) -> tuple[str, ...]:
        self.check(profile)
        rest = tuple(p for p in self.profiles if p != profile)
        if not rest:
            raise ValueError("need at least two profiles")
        return rest


def check_choice(name: str, value: str, allowed: Sequence[str]) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {sorted(allowed)}, got {value!r}")
    return value


# ---------------------------------------------------------------------------------------------
# Fixed values. These must equal the published study's tables for the results to match.
# ---------------------------------------------------------------------------------------------

CRAWL_TABLES = (
    "site_visits",
    "http_requests",
    "http_responses",
    "http_redirects",
    "javascript",
    "javascript_cookies",
    "callstacks",
)
ENRICHED_TABLES = (
    "http_requests_enriched",
    "javascript_cookies_enriched",
    "javascript_enriched",
)

# Confidence floors, inclusive.
CONFIDENCE_LEVELS = {
    "high": ("high",),
    "medium": ("high", "medium"),
    "low": ("high", "medium", "low"),
}

# Ad network patterns, in priority order.
AD_NETWORK_PATTERNS = (
    (r"safeframe\.googlesyndication\.com", "google_adsense"),
    (r"googlesyndication\.com", "google_adsense"),
    (r"doubleclick\.net", "google_doubleclick"),
    (r"2mdn\.net", "google_doubleclick"),
    (r"googleadservices\.com", "google_adservices"),
    (r"googletagservices\.com", "google_tagmanager"),
    (r"google\.com/ads", "google_other"),
    (r"amazon-adsystem\.com", "amazon"),
    (r"facebook\.com.*plugins", "facebook"),
    (r"criteo\.(com|net)", "criteo"),
    (r"taboola\.com", "taboola"),
    (r"outbrain\.com", "outbrain"),
    (r"adnxs\.com", "appnexus"),
    (r"pubmatic\.com", "pubmatic"),
    (r"rubiconproject\.com", "rubicon"),
    (r"openx\.net", "openx"),
    (r"adsrvr\.org", "thetradedesk"),
    (r"media\.net", "medianet"),
    (r"yahoo\.com.*ad", "yahoo"),
    (r"bing\.com.*ad", "microsoft_bing"),
)
NETWORK_FAMILIES = {
    "google_adsense": "google",
    "google_doubleclick": "google",
    "google_adservices": "google",
    "google_tagmanager": "google",
    "google_other": "google",
}

# Advertising pixel signatures: (label, domains, path patterns), in declared order.
PIXEL_SIGNATURES = (
    ("Meta Pixel",
     ("facebook.com", "connect.facebook.net", "facebook.net"),
     (r"/tr/?(\?|$)", r"/en_US/fbevents\.js", r"/signals/")),
    ("TikTok Pixel",
     ("analytics.tiktok.com", "analytics-sg.tiktok.com"),
     (r"/i18n/pixel", r"/api/v2/pixel", r"/pixel/")),
    ("DoubleClick",
     ("doubleclick.net", "g.doubleclick.net", "stats.g.doubleclick.net"),
     (r"/activity", r"/adview", r"/pagead/viewthroughconversion", r"/pagead/1p-user-list")),
    ("Google Ads Conversion",
     ("googleadservices.com", "googlesyndication.com"),
     (r"/pagead/conversion", r"/pagead/landing", r"/pagead/viewthrough")),
    ("LinkedIn Insight",
     ("px.ads.linkedin.com", "snap.licdn.com"),
     (r"/collect", r"/li\.lms-analytics/insight\.min\.js")),
    ("Microsoft UET",
     ("bat.bing.com",),
     (r"/action/", r"/bat\.js")),
    ("X/Twitter Pixel",
     ("analytics.twitter.com", "ads-twitter.com", "t.co"),
     (r"/i/adsct", r"/uwt\.js")),
    ("Pinterest Tag",
     ("ct.pinterest.com", "s.pinimg.com"),
     (r"/ct\.gif", r"/ct/", r"/v3/")),
    ("Snap Pixel",
     ("tr.snapchat.com", "sc-static.net"),
     (r"/p", r"/scevent\.min\.js")),
    ("Criteo",
     ("criteo.com", "criteo.net", "static.criteo.net"),
     (r"/delivery/", r"/load/", r"/tag/")),
    ("Taboola",
     ("taboola.com", "trc.taboola.com"),
     (r"/trc/", r"/pixel")),
    ("Outbrain",
     ("outbrain.com", "amplify.outbrain.com"),
     (r"/pixel", r"/OutbrainRatingsEngine")),
)
DEFAULT_TARGET_PIXELS = (
    "Meta Pixel",
    "DoubleClick",
    "Google Ads Conversion",
    "Criteo",
    "TikTok Pixel",
    "Pinterest Tag",
    "Snap Pixel",
    "Microsoft UET",
    "X/Twitter Pixel",
    "LinkedIn Insight",
)
# Platform flag column -> (pixel label, display name).
PLATFORM_FLAGS = {
    "has_meta": ("Meta Pixel", "Meta"),
    "has_tiktok": ("TikTok Pixel", "TikTok"),
    "has_doubleclick": ("DoubleClick", "DoubleClick"),
    "has_google_ads": ("Google Ads Conversion", "Google Ads"),
    "has_criteo": ("Criteo", "Criteo"),
}

RETARGETING_PARENTS = (
    "criteo",
    "nextroll",
    "liveramp",
    "google",
    "taboola",
    "teads",
    "microsoft",
    "indexexchange",
    "magnite",
    "pubmatic",
    "meta",
    "the trade desk",
    "rtbhouse",
    "quantcast",
    "amazon",
    "yahoo",
)

CANVAS_SYMBOLS = (
    "HTMLCanvasElement.toDataURL",
    "HTMLCanvasElement.toBlob",
    "CanvasRenderingContext2D.getImageData",
    "CanvasRenderingContext2D.fillText",
    "CanvasRenderingContext2D.strokeText",
    "CanvasRenderingContext2D.measureText",
)
WEBGL_SYMBOLS = (
    "WebGLRenderingContext.getParameter",
    "WebGLRenderingContext.getSupportedExtensions",
    "WebGLRenderingContext.getExtension",
    "WebGL2RenderingContext.getParameter",
)
AUDIO_SYMBOLS = (
    "AudioContext.createOscillator",
    "AudioContext.createDynamicsCompressor",
    "AudioContext.createAnalyser",
    "OfflineAudioContext.startRendering",
    "AudioBuffer.getChannelData",
)
NAVIGATOR_SYMBOLS = (
    "window.navigator.userAgent",
    "window.navigator.platform",
    "window.navigator.language",
    "window.navigator.languages",
    "window.navigator.hardwareConcurrency",
    "window.navigator.deviceMemory",
    "window.navigator.maxTouchPoints",
    "window.navigator.vendor",
    "window.navigator.appVersion",
    "window.navigator.doNotTrack",
    "window.navigator.cookieEnabled",
    "window.navigator.plugins",
    "window.navigator.mimeTypes",
)
SCREEN_SYMBOLS = (
    "window.screen.width",
    "window.screen.height",
    "window.screen.availWidth",
    "window.screen.availHeight",
    "window.screen.colorDepth",
    "window.screen.pixelDepth",
)
FONT_SYMBOLS = (
    "CanvasRenderingContext2D.measureText",
    "CanvasRenderingContext2D.font",
)
TECHNIQUE_SYMBOLS = {
    "canvas": CANVAS_SYMBOLS,
    "webgl": WEBGL_SYMBOLS,
    "audio": AUDIO_SYMBOLS,
    "navigator": NAVIGATOR_SYMBOLS,
    "screen": SCREEN_SYMBOLS,
    "font": FONT_SYMBOLS,
}
CANVAS_WRITE_SYMBOLS = (
    "CanvasRenderingContext2D.fillText",
    "CanvasRenderingContext2D.strokeText",
)
CANVAS_READ_SYMBOLS = (
    "HTMLCanvasElement.toDataURL",
    "CanvasRenderingContext2D.getImageData",
)
AUDIO_SETUP_SYMBOLS = (
    "AudioContext.createOscillator",
    "AudioContext.createDynamicsCompressor",
    "OfflineAudioContext.startRendering",
)
AUDIO_READ_SYMBOLS = ("AudioBuffer.getChannelData",)

# Exclusive keyword categories (first match wins, as a regex alternation).
CATEGORY_KEYWORDS = {
    "Retail": ("shop", "sale", "buy", "discount", "shipping", "cart",
               "% off", "deal", "order", "checkout", "free shipping"),
    "Finance": ("credit", "loan", "invest", "bank", "insurance",
                "crypto", "mortgage", "refinance", "apr"),
    "Health": ("doctor", "health", "medication", "symptom", "treatment",
               "wellness", "therapy", "prescription"),
    "Travel": ("flight", "hotel", "vacation", "trip", "resort",
               "book now", "cruise", "airline"),
    "Tech": ("software", "app", "cloud", "ai", "data", "platform",
             "download", "install"),
}
# Non-exclusive keyword categories (case-insensitive substring).
KEYWORD_CATEGORIES = {
    "retail": ("shop", "sale", "buy now", "discount", "free shipping",
               "cart", "order", "% off", "deal"),
    "finance": ("credit", "loan", "mortgage", "investment", "bank",
                "insurance", "apr", "savings", "crypto"),
    "health": ("doctor", "medication", "health", "symptoms", "treatment",
               "prescription", "pharmacy", "wellness", "therapy"),
    "travel": ("flight", "hotel", "vacation", "book now", "trip",
               "destination", "cruise", "resort"),
    "auto": ("car", "vehicle", "lease", "dealer", "suv", "truck",
             "mpg", "financing"),
    "tech": ("software", "app", "download", "subscribe", "cloud",
             "ai", "free trial", "platform"),
    "media": ("stream", "watch now", "episode", "season", "movie",
              "series", "podcast", "channel"),
    "food": ("recipe", "restaurant", "delivery", "meal", "order food",
             "menu", "dining"),
}

# Standard ad sizes: (width, height, label).
STANDARD_SIZES = (
    (728, 90, "728x90 leaderboard"),
    (300, 250, "300x250 medium rect"),
    (160, 600, "160x600 skyscraper"),
    (300, 600, "300x600 half-page"),
    (970, 250, "970x250 billboard"),
    (320, 50, "320x50 mobile banner"),
)
SMALL_AREA, SMALL_LABEL = 10000, "tiny (<100x100)"
LARGE_AREA, LARGE_LABEL = 250000, "large (>500x500)"
OTHER_SIZE = "non-standard"

# Cookie lifespan buckets: (upper bound in days, label); the last has no bound.
LIFESPAN_BUCKETS = (
    (0, "session"),
    (1, "<1d"),
    (7, "1-7d"),
    (30, "7-30d"),
    (365, "30-365d"),
    (None, "1y+"),
)
# Tracker intensity buckets: (inclusive upper bound, label); the last has no bound.
INTENSITY_BUCKETS = (
    (1, "1 (Low)"),
    (5, "2-5 (Med)"),
    (10, "6-10 (High)"),
    (None, "11+ (Extreme)"),
)

AD_CATEGORIES = (
    "Automotive",
    "Beauty & Personal Care",
    "Business Services",
    "Construction & Home Improvement",
    "Consumer Electronics",
    "Education",
    "Energy & Utilities",
    "Entertainment",
    "Fashion & Apparel",
    "Finance",
    "Food & Beverage",
    "Gaming",
    "Government & Public Services",
    "Health & Wellness",
    "Healthcare",
    "Home & Garden",
    "Industrial & Manufacturing",
    "Insurance",
    "Jewelry & Luxury Goods",
    "Legal Services",
    "Marketplace & Classifieds",
    "Media & Publishing",
    "Nonprofit & Charity",
    "Pets",
    "Real Estate",
    "Recruitment & Careers",
    "Restaurants & Dining",
    "Retail",
    "Software & SaaS",
    "Sports & Fitness",
    "Technology",
    "Telecommunications",
    "Travel & Hospitality",
    "Transportation & Logistics",
    "Consumer Packaged Goods",
    "Cryptocurrency & Web3",
    "Dating",
    "Events & Conferences",
    "Parenting & Family",
    "Photography & Creative Services",
    "Religion & Faith",
    "Security & Privacy",
    "Smart Home & IoT",
    "Streaming Services",
    "Subscription Services",
    "Toys & Hobbies",
    "Adult",
    "Political",
    "Public Safety",
    "Likely Scam",
    "Other",
    "None",
)

# Persona -> categories that count as on target.
PERSONA_AFFINITY = {
    "gaming": ("Consumer Electronics", "Entertainment", "Gaming", "Technology", "Retail",
               "Software & SaaS", "Cryptocurrency & Web3", "Security & Privacy",
               "Streaming Services", "Toys & Hobbies", "Events & Conferences"),
    "sports_car_fan": ("Automotive", "Construction & Home Improvement",
                       "Transportation & Logistics", "Toys & Hobbies"),
    "investor": ("Finance", "Business Services", "Recruitment & Careers", "Nonprofit & Charity",
                 "Cryptocurrency & Web3", "Real Estate", "Insurance", "Legal Services"),
    "retiree": ("Entertainment", "Beauty & Personal Care", "Government & Public Services",
                "Legal Services", "Real Estate", "Travel & Hospitality", "Parenting & Family",
                "Healthcare", "Events & Conferences"),
    "control": (),
}

# Zero-shot label sets per persona.
LABEL_SETS = {
    "shopper": (
        "a retail advertisement for clothing or shoes",
        "an advertisement for a specific product with a price or discount",
        "an electronics or gadget advertisement",
        "an advertisement for household or home goods",
        "a beauty or personal care advertisement",
        "a travel or hotel booking advertisement",
        "a food delivery or grocery advertisement",
        "a financial service, insurance, or credit card advertisement",
        "a generic brand logo with no product",
        "a public service announcement or news headline",
        "a blank, broken, or placeholder image",
    ),
    "control": (
        "a retail or e-commerce advertisement",
        "a financial service advertisement",
        "a travel advertisement",
        "a technology or software advertisement",
        "a healthcare or pharmaceutical advertisement",
        "an entertainment or media advertisement",
        "a generic brand logo with no product",
        "a public service announcement or news headline",
        "a blank, broken, or placeholder image",
    ),
}
NOISE_LABELS = ("a blank, broken, or placeholder image",)

OUTLIER_KEYWORDS = "<outliers / no clear topic>"

# Text of the label record's default and failure reasons.
LABEL_DEFAULT = "None"
REASON_EMPTY_CONTENT = "Empty response message content"
REASON_EMPTY = "Empty response"
REASON_UNREADABLE = "JSON output unreadable"
