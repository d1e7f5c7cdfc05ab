"""The short list of sectors that a visitor chooses by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OTHER = "Other"
# The groups, in the order of a menu, and the labels of sources that each stands for.
GROUPS = {
    "AI & Data": ("AI", "AI infrastructure", "Enterprise AI", "Enterprise AI software", "Sales AI", "Vertical AI", "Industrial AI", "Maritime AI", "Computer vision", "Data", "Data infrastructure", "Analytics"),
    "Software & DevTools": (
        "SaaS", "B2B SaaS", "DevTools", "Enterprise", "Enterprise Software", "Productivity SaaS", "Strategy SaaS", "Engineering SaaS", "Contact-centre SaaS", "Video software",
        "HR Tech", "HR", "Workforce", "Legal tech", "Legaltech", "GRC", "Martech", "Adtech", "Research Tech", "Web3",
    ),
    "Cybersecurity": ("Cybersecurity",),
    "Fintech": ("Fintech", "Insurtech", "WealthTech", "Open banking"),
    "Health & Biotech": ("HealthTech", "Medtech", "Biotech", "Telehealth", "Aged", "Wearables"),
    "Climate & Energy": ("Energy", "Climate", "ClimateTech", "Climate SaaS", "ESG SaaS", "Green ammonia"),
    "Food & Agriculture": ("AgTech", "Food", "Alt-protein", "Cellular agriculture"),
    "Consumer & Commerce": (
        "Consumer", "Marketplace", "Retail", "Retail media", "Ecommerce", "Fashion", "Sports", "Media", "Gaming", "Gaming infrastructure", "Travel", "Experiences",
        "Hospitality", "Hospitality Tech", "Hospitality SaaS",
    ),
    "Education": ("EdTech",),
    "Property & Construction": ("PropTech", "Construction SaaS", "Construction safety SaaS"),
    "Industrial & Logistics": ("Logistics", "Logistics SaaS", "Industrial Automation", "Manufacturing", "Mining Tech", "Mobility", "Automotive", "Automotive SaaS", "Automotive data", "Packaging"),
    "Deep Tech & Space": ("Space", "Satellite IoT", "Geospatial", "Quantum", "Quantum computing", "Hardware", "Robotics", "Defence", "Spatial Computing", "VR"),
    OTHER: ("Community",),
}
MISSING = ("", "unknown", "n/a", "none")


def _key(label: Column) -> Column:
    return F.lower(F.trim(F.coalesce(label, F.lit(""))))


def group_of(label: Column) -> Column:
    """The group of a label; OTHER for a label that no group names, null for no sector."""
    named = F.create_map(*[F.lit(x) for group, labels in GROUPS.items() for one in labels for x in (one.lower(), group)])
    k = _key(label)
    return F.when(~k.isin(*MISSING), F.coalesce(F.element_at(named, k), F.lit(OTHER)))


def is_placed(label: Column) -> Column:
    """Whether the table says where a label belongs."""
    return _key(label).isin(*MISSING, *[one.lower() for labels in GROUPS.values() for one in labels])
