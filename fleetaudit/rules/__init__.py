"""Rule packs: functions from repository tables to findings, and the registry that runs them."""
