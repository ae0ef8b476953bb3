"""DataFrame operators: listing, engagement, alerting, queues, matching, scoring, selection."""
