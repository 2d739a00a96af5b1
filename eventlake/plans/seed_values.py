"""Fixed values of the demo tenant: ids, texts, states, counts and ages. Its brand name and tagline are placeholders."""

TENANT = "local"

ENVIRONMENT = {
    "brand_name": "Brand Name",
    "brand_tagline": "Brand Tagline",
    "hero_title": "Your communication",
    "hero_accent": "Intelligence Hub.",
    "hero_note": "All systems secure",
    "search_placeholder": "Search secure archives...",
    "session_label": "Active Session",
    "session_node": "Encrypted Node: 04X-88",
    "session_status": "online",
    "campaigns_headline": "Campaigns",
    "campaigns_description": "Orchestrate your high-fidelity communications with fortified precision and editorial grace.",
    "subscribers_headline": "Subscribers",
    "subscribers_description": "Orchestrate your network with absolute privacy and editorial precision.",
    "analytics_headline": "Interaction Telemetry",
    "analytics_description": "Live appdb aggregates now drive the dashboard, campaign rates, and bootstrap payload while the platform reference content remains relational and seedable.",
    "security_title": "DMARC Status",
    "security_status": "Verified",
    "security_description": "Your sending domain remains fully authenticated and protected against spoofing.",
    "billing_eyebrow": "Pro Plan Active",
    "billing_title": "Next Billing",
    "billing_date": "May 24, 2026",
    "billing_action": "Manage Subscription",
}

# id, title, summary, status, audience, audience label, action label, tone
CAMPAIGNS = (
    ("spring-capital-briefing", "Spring Capital Briefing", "Sent Apr 08, 2026", "Sent", 46800, "High Value circle", "Inspect performance", "primary"),
    ("monthly-security-digest", "Monthly Security Digest", "Scheduled for Apr 15, 2026", "Scheduled", 17240, "Newly verified readers", "Preview draft", "muted"),
    ("product-unveiling-zenith", "Product Unveiling: Zenith", "Last edited 2 hours ago", "Draft", 28400, "Board list and strategic partners", "Launch test send", "tertiary"),
    ("quarterly-insight-report", "Quarterly Insight Report", "Sent Mar 21, 2026", "Sent", 118000, "Global partners", "Export report", "primary"),
    ("member-reengagement-arc", "Member Re-engagement Arc", "Queued for segment backfill", "Sent", 9860, "Inactive subscribers", "Inspect audience", "muted"),
)

# campaign id, delivered, opened, clicked, bounced, first seen, last seen and refreshed as ages in minutes
CAMPAIGN_ANALYTICS = (
    ("spring-capital-briefing", 4200, 1520, 390, 14, 12960, 18, 8),
    ("monthly-security-digest", 0, 0, 0, 0, None, None, 12),
    ("product-unveiling-zenith", 0, 0, 0, 0, None, None, 12),
    ("quarterly-insight-report", 5300, 1140, 285, 9, 21600, 1440, 1440),
    ("member-reengagement-arc", 1800, 360, 54, 6, 10080, 4, 4),
)

# page, event, events, users, first seen, last seen and refreshed as ages in minutes
ENGAGEMENT_ANALYTICS = (
    ("/dashboard", "navigation.select", 218, 73, 4320, 4, 4),
    ("/campaigns", "campaign-summary.inspect", 97, 31, 2880, 16, 16),
    ("/subscribers", "subscriber-filters.select-filter", 164, 48, 8640, 42, 42),
    ("/analytics", "telemetry-signal.open-analytics-view", 71, 22, 5760, 83, 83),
)

# events per day, oldest first, the last is today
DAILY_EVENTS = (3250, 5180, 4720, 3910, 5570, 6120, 2980)

FILTERS = ("All Contacts", "High Value", "Inactive", "Newly Verified")

# segment id, label, percentage
GROWTH_SEGMENTS = (
    ("us", "United States", "82.00"),
    ("uk", "United Kingdom", "64.00"),
    ("sg", "Singapore", "49.00"),
    ("de", "Germany", "41.00"),
)

# id, name, e-mail, security status, created (days ago), last seen (minutes ago), tone, segments, tags
FEATURED_SUBSCRIBERS = (
    ("evelyn-sterling", "Evelyn Sterling", "e.sterling@private.com", "Encrypted", 12, 24, "primary", ("VVIP", "Q4 Launch"), ("High Value", "Newly Verified")),
    ("marcus-aurelius-ii", "Marcus Aurelius II", "m.aurelius@heritage.org", "Screening", 148, 12960, "muted", ("Art Collector",), ("Inactive",)),
    ("julian-thorne", "Julian Thorne", "jthorne@global.nexus", "Encrypted", 43, 4320, "primary", ("Board List", "Europe"), ("High Value",)),
    ("amira-sterling", "Amira Sterling", "amira@capital.circle", "Review", 27, 10080, "tertiary", ("High Intent", "VIP"), ("High Value",)),
    ("noah-vesper", "Noah Vesper", "nvesper@portfolio.one", "Encrypted", 4, 42, "primary", ("New Investors", "APAC"), ("Newly Verified",)),
    ("lila-somerset", "Lila Somerset", "lila@somerset.foundation", "Dormant", 220, 30240, "muted", ("Legacy Circle",), ("Inactive",)),
)

# activity id, title, description, age in minutes, tone
ACTIVITIES = (
    ("executive-brief-sent", "Executive Briefing dispatched", "Seeded audience cohorts are now mirrored into appdb-backed platform views.", 18, "primary"),
    ("segment-refresh", "High Value cohort refreshed", "Segment tags are normalized in SQL and displayed through the subscriber filters.", 120, "success"),
    ("privacy-review", "Privacy review cleared", "The seed model is no longer compiled into the binary and can be recreated from SQL.", 300, "muted"),
    ("launch-draft", "Zenith launch draft edited", "Campaign performance cards now read live delivery, open, and click rates from appdb.", 1440, "primary"),
)

# pipeline id, title, description, status
PIPELINES = (
    ("ui", "Svelte Interaction", "Buttons, filters, row actions, and navigation emit typed commands through the embedded Go API.", "Live"),
    ("seed", "Normalized SQL Seed", "Reference content is stored in relational appdb tables while the bootstrap payload is assembled by SQL views.", "Seeded"),
    ("gateway", "Event Gateway", "The backend proxies operator intent to analytics and campaign events while Redpanda remains the only operational event ingress.", "Connected"),
)

# signal id, title, description, action, event kind, subject type, subject id
SIGNALS = (
    ("nav-analytics", "Open analytics view", "Publishes an analytics event for navigation focus.", "open-analytics-view", "analytics", "navigation", "analytics"),
    ("create-brief", "Create new brief", "Creates an appdb-backed campaign row and emits analytics and campaign events to Redpanda.", "create-brief", "both", "campaign", "new-brief"),
    ("launch-test-send", "Launch a test send", "Updates the selected campaign while the emitted operational events stay in Redpanda topics.", "launch-test-send", "both", "campaign", "product-unveiling-zenith"),
)
