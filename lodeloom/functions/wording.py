"""The wording of prompts, which must be the same in training and use."""

# Fixed values -----------------------------------------------------------------
REPLY_HEAD = (
    "Write a concise, professional customer support reply to the ticket below. Keep the reply focused and under 150 words. "
    "Do not use markdown headers or bullet points. Do not invent case studies or external links.\n\n"
)
ASPECT_HEAD = (
    "Write a concise, professional customer support reply. Keep the reply under 150 words. Do not use markdown headers or bullet points. "
    "Do not invent case studies or external links.\n"
)
GUIDED_HEAD = (
    "You are a professional customer support agent. Write a concise reply (under 150 words) to the new ticket below. "
    "Use the similar resolved tickets as reference only. Do not use markdown headers or bullet points. "
    "Do not invent case studies or external links.\n\nSIMILAR RESOLVED TICKETS:\n"
)
NO_EXAMPLES = "(no examples retrieved)"
T5_HEAD = "Write a professional customer support reply to the following ticket.\n\n"
TICKET_HEAD = "Customer support ticket:\n"
AGENT_REPLY = "Support agent reply:\n"
T5_GENERATE = "Generate customer support response:\n"
T5_TASK = "support task: "
TURN_HEAD = "<start_of_turn>user\nYou are a support agent. Respond to this ticket:\n"
TURN_END = "<end_of_turn>\n<start_of_turn>model\n"
INTENT_CHOICE = "performance_issue | login_or_access | billing_issue | feature_request | service_outage | general_inquiry | data_or_integration"
TYPE_CHOICE = "complaint | escalation | feedback | product_support"
CLASSIFY_HEAD = "Classify this support ticket. Extract ONLY intent and ticket_type_nli.\n\n"
FIELDS_HEAD = "Extract 5 fields from this support ticket as a JSON object with keys: prob_sub, prob_statement, cause, intent, ticket_type_nli.\n\n"
FIELD_NAMES = ["prob_sub", "prob_statement", "cause", "intent", "ticket_type_nli"]
FIELD_DEFAULTS = {"intent": "general_inquiry", "ticket_type_nli": "product_support"}
BOS = "<bos>"
# -------------------------------------------------------------------------------
