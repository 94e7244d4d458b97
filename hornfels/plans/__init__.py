"""Programs: terms, builder, validation, stratification, compilation of rules, fixpoints."""
