"""Nothing yet: the engine works on finite tables, and no query of the dialect is continuous."""
