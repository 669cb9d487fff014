"""The three jobs: harvest QA rows from pages, evaluate models, generate questions from tables."""
