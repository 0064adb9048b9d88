"""Business days, holiday rules and trading schedules; small dimension tables to join with."""
