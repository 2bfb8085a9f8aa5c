"""Phrases by intent, in English and in Hindi and Tamil, native and romanised.

A phrase is a sequence of words; "/" stands between words of which any may stand at that place, and 0
is any number. Names and weights are the fixed values that scores depend on. The phrases are
this engine's own: what a sender with that intent would write, by the remark beside each group.
"""

from __future__ import annotations

from itertools import product

# The intents and their weights.
WEIGHTS = {
    "urgency": 0.14, "fear": 0.14, "account_suspension": 0.2, "credential_request": 0.28, "otp_request": 0.34, "password_reset": 0.16, "identity_verification": 0.22, "payment_request": 0.2, "upi_collect": 0.34,
    "remote_access": 0.34, "attachment_lure": 0.14, "executive_impersonation": 0.22, "authority_impersonation": 0.2, "reward_bait": 0.2, "invoice_fraud": 0.16, "delivery_scam": 0.18, "job_scam": 0.2,
    "utility_disconnection": 0.24, "secrecy": 0.14, "generic_greeting": 0.06,
}

_PHRASES = {
    "urgency": """  # no time to think
        urgent; urgently; immediately; right away; without delay; at the earliest; as soon as possible; do not delay/wait; act/call/respond/reply/click now; act today; in/within 0 minutes/hours/hour/days/day;
        in/within the next 0 minutes/hours/days; before midnight; by tonight; final/last reminder/notice/warning/chance; time is running out; expires/ends/closes today/tonight/tomorrow/soon; only today; jaldi karo/karen/kijiye; turant; abhi call;
        तुरंत; फौरन; जल्दी करें; आज ही; உடனடியாக; உடனே; இப்போதே; இன்றே; udane; udanadiyaga""",
    "fear": """  # something bad follows
        will be blocked/suspended/closed/deleted/locked/disabled/frozen/terminated/deactivated/disconnected; has been blocked/suspended/locked/disabled/frozen/compromised/hacked/restricted; is/was blocked/suspended/compromised/hacked; will be
        permanently deleted/closed/blocked; lose access; legal action/notice/proceedings; court case; penalty will/of; a penalty; fined; unusual/suspicious/unauthorised/unauthorized activity/login/transaction/sign; block ho jayega; band ho jayega/jaega;
        बंद हो जाएगा/जाएगी; ब्लॉक हो जाएगा; कानूनी कार्रवाई; துண்டிக்கப்படும்; முடக்கப்படும்; தடை செய்யப்படும்; mudakkappadum""",
    "account_suspension": """  # the account itself is held back
        account/mailbox/profile/card is suspended/blocked/locked/restricted/limited/deactivated/disabled; account/mailbox/profile/card has been suspended/blocked/locked/restricted/limited/deactivated/disabled; account/mailbox/profile/card will be
        suspended/blocked/locked/closed/deactivated/disabled; suspended your account/card/profile; locked your account; suspension of your account; account suspension; mailbox is full; mailbox quota; storage is full; storage limit; storage almost full;
        khata band; खाता बंद/निलंबित; கணக்கு முடக்கப்பட்டது/முடக்கப்படும்""",
    "credential_request": """  # the reader is to give or enter log-in data
        verify/confirm/validate/update/unlock/restore/reactivate/authenticate your account/login/profile/mailbox/credentials/details/information/password/email; verify/confirm/update account details/information; log in to continue/confirm/verify/restore/keep;
        login/signin to continue/confirm/verify/restore/keep; sign in to continue/confirm/verify/restore/keep; log in here/below/now; sign in here/below/now; login here/below/now; enter your password/passcode/credentials/username; provide your
        password/credentials/login; click here/below to verify/confirm/update/login/unlock; click the link to verify/confirm/update/login/unlock; लॉगिन करें; पासवर्ड दर्ज करें; உள்நுழைய; உள்நுழைக""",
    "otp_request": """  # a one-time code is asked for
        share/send/tell/give/forward/provide/read/submit otp/cvv/mpin; share/send/tell/give/forward/provide/read/submit the/your/me/us otp/cvv/mpin/passcode/pin/code; give/tell/send me the/your otp/code/pin; read out the otp/code; otp you received;
        otp batao/bataiye/bhejo/bhejiye/dijiye/do; otp sollunga/anuppunga/kudunga; ओटीपी भेजें/बताएं/बताइए/साझा; ओटीपी; ஓடிபி; otp சொல்லுங்கள்/அனுப்புங்கள்""",
    "password_reset": """  # a new password
        reset/change/renew your password/passcode; reset password; password reset; password has expired; password will expire; password expires/expired/expiring; new password required; पासवर्ड बदलें/रीसेट; கடவுச்சொல்லை மாற்ற/மாற்றவும்""",
    "identity_verification": """  # papers and know-your-customer checks
        kyc; rekyc; ekyc; know your customer; verify/confirm/prove your identity; identity verification; aadhaar/aadhar/pan number/card/verification; link/update your aadhaar/aadhar/pan; link/update aadhaar/aadhar/pan; केवाईसी; आधार अपडेट/लिंक; கேஒய்சி; ஆதார் இணைக்க/எண்""",
    "payment_request": """  # money is to be sent
        pay/transfer/send/deposit/remit the/a/an/your/this amount/money/fee/fees/charges/fine/balance/sum; pay/transfer/send rs/inr/usd/rupees; pay rs/inr/usd 0; pay the customs/processing/delivery/registration/handling/clearance fee/fees/charge/charges/duty;
        customs/processing/registration/handling/clearance fee/fees/charge/charges; refundable deposit; security deposit; advance payment; clear your/the dues/bill/balance; payment of rs/inr/usd; paise bhejo/bhej/bhejiye; पैसे भेजें/भेज; भुगतान करें;
        பணம் அனுப்ப/அனுப்பவும்/செலுத்தவும்/கட்டவும்; panam anuppu/anuppunga; kattanam""",
    "upi_collect": """  # paying disguised as being paid
        upi pin; enter your pin to receive/get/claim/accept; enter pin to receive/get/claim/accept; scan to receive/get/claim; scan the/this qr to receive/get/claim; scan the/this qr code to receive/get/claim; approve/accept the request to receive/get;
        approve/accept to receive/get/claim; collect request""",
    "remote_access": """  # software that hands over the screen
        anydesk; teamviewer; quicksupport; rustdesk; airdroid; ultraviewer; supremo; screen sharing app; remote access/desktop/support; install/download this/the/our apk; install/download this/the/our support app; apk file; share your screen""",
    "attachment_lure": """  # something waits to be opened
        see/open/view/review/check/download the/your attached/attachment/enclosed; see/open/view/review/check/download attached/attachment; see/open/view/download the document/file/pdf; attached document/file/invoice/statement/receipt; attachment for details;
        shared a document/file/folder; new voicemail/fax; secure/encrypted message/document""",
    "executive_impersonation": """  # a superior asks for a favour
        are you available/free; quick/small favour/favor/task; gift card/cards; giftcard; giftcards; wire transfer; stuck in a meeting; i am in a meeting; in a meeting right now; need you to purchase/buy; keep this between us; on my behalf""",
    "authority_impersonation": """  # police, court, tax, customs, regulator
        police; cybercrime; cyber crime; cbi; narcotics; enforcement directorate; reserve bank; rbi; trai; income tax; tax department; customs department/officer/office; money laundering; digital arrest; arrest warrant; under arrest; court summons; magistrate; गिरफ्तार; पुलिस; வழக்கு; கைது; காவல்துறை""",
    "reward_bait": """  # a gain out of nothing
        congratulations; you/have won; winner; lucky draw/winner; lottery; jackpot; cash prize; prize money; claim your/the reward/prize/gift/cashback/refund/bonus; cashback of/has; cashback credited; reward points; free gift/iphone/recharge/laptop/voucher; gift voucher; inaam; lottery lagi; इनाम; लॉटरी; பரிசு; parisu""",
    "invoice_fraud": """  # a bill, or where it is to be paid
        overdue/unpaid/outstanding/pending invoice/bill/payment; invoice is overdue/unpaid/due; invoice overdue; new/changed/updated bank details/account; new/changed/updated banking details; bank details have changed; change of bank details; remittance advice; payment confirmation; proforma invoice""",
    "delivery_scam": """  # a parcel that doesn't arrive
        parcel/package/shipment/courier/consignment is/was/has/could/cannot/on; parcel/package/shipment/courier/consignment delivery; delivery failed/attempt/unsuccessful; failed delivery; unable to deliver; could not be delivered; reschedule delivery/your; redelivery; delivery address/fee; held at customs""",
    "job_scam": """  # easy work, sure gains
        part time job/jobs/work; work from home; home based job/work; online job/jobs; earn 0; earn rs/inr/usd/up/daily/money; earn from home; per day income; daily income; prepaid task/tasks; guaranteed return/returns/profit/income; double your money; trading tips/group/signals; ghar baithe kamaye; घर बैठे कमाएं""",
    "utility_disconnection": """  # power, gas, line
        electricity/power/connection/gas/water will be disconnected/cut/stopped; electricity/power/gas/water connection/supply; electricity bill/department/office/officer; disconnection of your/electricity/power; bijli/connection kat jayega; बिजली कनेक्शन/बिल; மின் இணைப்பு; மின்சாரம் துண்டிக்கப்படும்; min inaippu""",
    "secrecy": """  # nobody is to know
        confidential; do not tell/inform/share/discuss; tell/inform no one/nobody; keep this/it secret/private/quiet/confidential; between us; strictly private; kisi ko mat; किसी को न बताएं; யாரிடமும் சொல்ல; yaaridamum solla""",
    "generic_greeting": """  # nobody in particular
        dear customer/user/client/member/sir/madam/beneficiary/subscriber/friend; dear account holder/user; dear valued customer/client/member; dear card holder; dear accountholder/cardholder; hello customer/user; प्रिय ग्राहक; அன்பார்ந்த/அன்புள்ள வாடிக்கையாளர்""",
}


def expand(template: str) -> list[str]:
    """All phrases of a template."""
    return [" ".join(words) for words in product(*(place.split("/") for place in template.split()))]


def _group(text: str) -> tuple[str, ...]:
    listed = text.split("\n", 1)[-1] if text.lstrip().startswith("#") else text
    return tuple(dict.fromkeys(p for t in listed.split(";") for p in expand(t.strip()) if p))


#: (id, weight, phrases).
INTENTS = tuple((name, WEIGHTS[name], _group(text)) for name, text in _PHRASES.items())
