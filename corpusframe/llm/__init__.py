"""Training-data operators: mixing, substring and near-duplicate removal, tokenization, privacy,
licences, fingerprints, language and quality. Nothing outside this subpackage imports it."""
