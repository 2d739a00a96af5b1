"""Fixed values.

Texts, names, limits and defaults that results must carry exactly. They are data,
kept together here so that the operators hold only logic.
"""

# Topics and bronze layout
EMAIL_TOPIC = "email_events_raw"
ANALYTICS_TOPIC = "analytics_events_raw"
CORRELATION_HEADER = "x-correlation-id"
BRONZE_PREFIX = "bronze"
UNKNOWN_TOPIC = "unknown"
SNAPSHOT_KEY_PREFIX = "lakehouse/ingress/third_party/captured_at="
SNAPSHOT_KEY_SUFFIX = "/snapshot.json"
SNAPSHOT_STAMP = "yyyyMMdd'T'HHmmss'Z'"

# Payload parsing
DATE_PREFIX_PATTERN = "^[0-9]{4}-[0-9]{2}-[0-9]{2}"
CONSOLIDATED_EVENT_TYPE = "consolidated"
CAMPAIGN_SOURCE = "platform_campaign_analytics"
ENGAGEMENT_SOURCE = "platform_engagement_analytics"

# Relative time
NO_ACTIVITY = "No recent activity"
JUST_NOW = "Just now"
DATE_LABEL = "MMM dd, yyyy"
SYNC_PREFIX = "Last analytics sync: "

# Dashboard figures: id, label, accent, icon, detail, display order
SENT_STATUS = "Sent"
SUBSCRIBERS_CARD = ("total-subscribers", "Total Subscribers", "success", "group", "CRUD-synced subscriber registry", 1)
OPEN_RATE_CARD = ("avg-open-rate", "Avg. Open Rate", "primary", "mail", "Refreshed from campaign aggregates", 2)
CLICK_RATE_CARD = ("click-through-rate", "Click Through Rate", "muted", "ads_click", "Refreshed from campaign aggregates", 3)
OPENS_TEXT = " opens from consolidated campaign analytics"
CLICKS_TEXT = " clicks from consolidated campaign analytics"
THIS_MONTH_TEXT = "% this month"

# Campaign summary: id, label, tone, display order
REACH_CARD = ("total-reach", "Total Reach", "muted", 1)
ENGAGEMENT_CARD = ("avg-engagement", "Avg Engagement", "primary", 2)
DELIVERABILITY_CARD = ("deliverability", "Deliverability", "progress", 3)
SENT_CAMPAIGNS_TEXT = " sent campaigns"
DELIVERIES_TEXT = " deliveries consolidated"
BOUNCES_TEXT = " bounced addresses"
ZERO_PERCENT = "0.0%"

# Dashboard bars
BAR_DAYS = 7
BAR_MIN_HEIGHT = 18
BAR_MAX_HEIGHT = 94
PERFORMANCE_TITLE = "Campaign Performance"
PERFORMANCE_MODES = ("Daily", "Weekly")
NO_RATE = "--"

# Live analytics overlay
OVERLAY_HEADLINE = "Real-time Analytics"
OVERLAY_PIPELINE = ("realtime", "Real-time Analytics via Trino", "Serving aggregates read from ClickHouse through Trino", "ok")
OVERLAY_DESCRIPTION = "Open %d • Click %d • Delivered %d"

# Search
ALL_CONTACTS = "All Contacts"

# Commands
DEFAULT_USER = "platform-operator"
DEFAULT_ROUTE = "dashboard"
DEFAULT_KIND = "auto"
DASHBOARD_ROUTE = "/dashboard"
CREATE_BRIEF = "create-brief"
LAUNCH_TEST_SEND = "launch-test-send"
ADD_SUBSCRIBER = "add-subscriber"
CAMPAIGN_PLACEHOLDERS = ("", "new-brief", "new-campaign")
SUBSCRIBER_PLACEHOLDER = "new-subscriber"
EMAIL_CAMPAIGN_FALLBACK = "platform-ui"
EMAIL_TYPE_PREFIX = "ui_"
ID_STAMP = "yyyyMMddHHmmss"
BRIEF_ACTION_FALLBACK = "campaign-brief"
BRIEF_DEFAULTS = {
    "summary": "Created from the operator console just now",
    "status": "Draft",
    "audienceCount": 6400,
    "audienceLabel": "Curated audience pending review",
    "actionLabel": "Launch test send",
    "tone": "tertiary",
}
SCHEDULED_VALUES = {
    "status": "Scheduled",
    "summary": "Test send queued just now",
    "action_label": "Inspect performance",
    "tone": "primary",
}
SUBSCRIBER_DEFAULTS = {
    "name": "Curated Contact",
    "securityStatus": "Encrypted",
    "tone": "primary",
    "assignedSegments": ("Priority Review",),
    "filterTags": ("Newly Verified",),
}
SUBSCRIBER_EMAIL_DOMAIN = "@curator.local"

# Generated subscribers
SEED_MEMBERS = 12836
SEED_RECENT_MEMBERS = 1424
SEED_REVIEW_EVERY = 31
SEED_ORDER_BASE = 1000
SEED_ID_PREFIX = "seed-member-"
SEED_NAME_PREFIX = "Portfolio Member "
SEED_EMAIL_PREFIX = "member"
SEED_EMAIL_DOMAIN = "@seed.curator.local"

# Metric samples
RATIO_FLOOR = 0.001
SERVER_ERROR_PATTERN = "^5..$"
P95 = 0.95
