"""Traffic channels of a visit's source, medium and referrer."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from clickloom.functions.props import any_of

# Names that decide the channel.
PAID_MEDIUMS = ["cpc", "ppc", "paid", "paid_search", "paid-social", "paid_social", "ads"]
SEARCH_NAMES = ["google", "bing", "yahoo", "duckduckgo", "baidu", "yandex"]
SOCIAL_NAMES = [
    "facebook", "instagram", "linkedin", "twitter", "x.com", "t.co", "reddit", "youtube", "tiktok", "threads",
]
SOCIAL_HOSTS = ["x.com", "t.co"]
AI_NAMES = {
    "OpenAI": ["chatgpt", "openai"],
    "Perplexity": ["perplexity"],
    "Anthropic": ["claude", "anthropic"],
    "Google Gemini": ["gemini", "bard.google"],
    "Microsoft Copilot": ["copilot", "bing.com/chat"],
}


def _contains_any(text: Column, names: list[str]) -> Column:
    return any_of(text.contains(n) for n in names)


def ai_provider(text: Column) -> Column:
    """The assistant behind a referrer, or NULL."""
    low = F.lower(text)
    found = F
    for provider, names in AI_NAMES.items():
        found = found.when(_contains_any(low, names), F.lit(provider))
    return found


def is_paid(medium: Column) -> Column:
    return medium.isin(PAID_MEDIUMS)


def is_search(text: Column) -> Column:
    return _contains_any(text, SEARCH_NAMES)


def is_social(text: Column, exact_hosts: bool = False) -> Column:
    """Substring test; ``exact_hosts`` stops short hosts matching inside longer ones."""
    if not exact_hosts:
        return _contains_any(text, SOCIAL_NAMES)
    long_names = [n for n in SOCIAL_NAMES if n not in SOCIAL_HOSTS]
    hosts = "|".join(h.replace(".", r"\.") for h in SOCIAL_HOSTS)
    return _contains_any(text, long_names) | text.rlike(rf"(^|[^a-z0-9.-])(www\.)?({hosts})($|[^a-z0-9.-])")


def channel(source: Column, medium: Column, referrer: Column, exact_hosts: bool = False) -> Column:
    """One of twelve channels; the first rule that holds decides."""
    src, med, ref = (F.lower(F.coalesce(c, F.lit(""))) for c in (source, medium, referrer))
    everything = F.concat_ws(" ", src, med, ref)
    social, search, paid = is_social(everything, exact_hosts), is_search(everything), is_paid(med)
    return (
        F.when((F.trim(everything) == "") | (src == "direct") | (ref == "direct"), "Direct")
        .when(ai_provider(everything).isNotNull(), "AI Referrals")
        .when((med == "email") | src.contains("mail"), "Email")
        .when(med.contains("affiliate"), "Affiliate")
        .when(med.contains("display") | med.contains("banner"), "Display")
        .when(social & paid, "Paid Social")
        .when(social, "Organic Social")
        .when(search & paid, "Paid Search")
        .when(search, "Organic Search")
        .when(paid, "Paid Other")
        .when(ref != "", "Referral")
        .otherwise("Other")
    )


def referrer_host(url: Column) -> Column:
    """Lower-case host of a URL; NULL when it does not parse."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))
